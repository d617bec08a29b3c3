"""Best-fit packing of whole documents into sequences of fixed length by patterns of lengths.

Documents are encoded once; those over the limit are cut, all others stay whole. What is packed is then only a histogram: how many
pieces have each length. Patterns of two to four lengths that fill a sequence are enumerated, their repeat counts fitted to the
histogram by non-negative least squares, rounded, capped by what there is, and whatever remains is packed best-fit decreasing, length by length, into
the gaps of the pattern sequences and new ones. The plan says, for each length, which runs of its pieces go where; pieces are numbered inside their length,
task by task, and look their place up. The histogram and the plan are bounded by the sequence length, not by the corpus.

Defined results. A null or empty text is the single token 0. Repeated rows are packed each. A null id stays null. An empty table gives an empty
table. Other columns are dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, id_columns, ids_back, lookup, written
from .tokenizer import vocabulary, word_bpe

LENGTH = 2048
END = 0
#: So many patterns are enumerated at most, and of them so many, evenly spread, are fitted: few enough that repeat counts exceed one.
PATTERNS = 400_000
FITTED = 8192
STEPS = 150


def patterns(lengths: np.ndarray, capacity: int, most: int = PATTERNS) -> np.ndarray:
    """(n, 4) lengths in falling order, 0 for none, each row filling the capacity exactly: pairs, triples and quadruples of the lengths there are."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    have[0] = False
    l = np.flatnonzero(have)
    out = []
    if have[capacity]:
        out.append(np.array([[capacity, 0, 0, 0]]))
    a = l[(l * 2 >= capacity) & (l < capacity)]
    a = a[have[capacity - a]]
    out.append(np.stack([a, capacity - a, 0 * a, 0 * a], axis=1))
    left = most - sum(map(len, out))
    for a in l[::-1]:
        if left <= 0 or a * 3 < capacity:
            break
        b = l[(l <= a) & (l * 2 >= capacity - a) & (l < capacity - a)]
        b = b[have[capacity - a - b]]
        out.append(np.stack([np.full(len(b), a), b, capacity - a - b, 0 * b], axis=1)[:left])
        left -= len(b)
    # quadruples of two pairs of near lengths, so that short documents have patterns too
    step = max(1, len(l) * len(l) // 60_000)
    grid = l[:: max(1, int(step**0.5))]
    for a in grid[::-1]:
        if left <= 0 or a * 4 < capacity:
            break
        b = grid[(grid <= a)]
        for c in b[:: max(1, len(b) // 24)]:
            d = capacity - a - b - c
            ok = (d > 0) & (d <= c) & (c <= b)
            ok[ok] = have[d[ok]]
            out.append(np.stack([np.full(ok.sum(), a), b[ok], np.full(ok.sum(), c), d[ok]], axis=1)[: max(0, left)])
            left -= int(ok.sum())
    return np.concatenate(out) if out else np.zeros((0, 4), dtype=np.int64)


def nnls(rows: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that minimises the weighted squares of counts - A x, where column k of A counts the lengths rows[k]. Accelerated projected gradient; A is never made dense."""
    size = len(counts)
    weight = 1.0 / np.maximum(counts, 1.0)
    weight[0] = 0.0

    def forward(x):
        return np.bincount(rows.ravel(), weights=np.repeat(x, rows.shape[1]), minlength=size) * (np.arange(size) > 0)

    def back(r):
        return (weight * r)[rows].sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(12):  # largest eigenvalue, for the step
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top or 1.0
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y + back(counts - forward(y)) / (1.05 * top or 1.0))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        if np.dot(y - new, new - x) < 0:
            t_new = 1.0
        x, t = new, t_new
    return x


def fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Repeat counts and patterns [(length, times)] that hold all counts (by length, 0 to capacity) exactly."""
    counts = counts.astype(np.int64).copy()
    plan: list[tuple[int, list[tuple[int, int]]]] = []
    if counts[capacity]:
        plan.append((int(counts[capacity]), [(capacity, 1)]))
        counts[capacity] = 0
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return plan
    rows = patterns(lengths, capacity)
    rows = rows[np.linspace(0, len(rows) - 1, min(len(rows), FITTED)).astype(int)]
    x = nnls(rows, counts.astype(float))
    # rounding to the nearest uses the patterns most, rounding down less keeps short pieces for the gaps; the plan with the fewest sequences stays
    tried = [_rounded(rows, x, np.floor(share * x + up), counts, capacity) for share, up in ((1, 0.5), (1, 1e-6), (0.8, 1e-6))]
    return plan + min(tried, key=lambda p: sum(n for n, _ in p))


def _rounded(rows, x, repeats, counts, capacity):
    """Patterns by their repeats while there are pieces, then the residuals."""
    left, plan = counts.copy(), []
    for k in np.argsort(-x, kind="stable"):
        if repeats[k] < 1:
            continue
        l, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
        if n := int(min(repeats[k], *(left[l] // times))):
            left[l] -= n * times
            plan.append((n, list(zip(l.tolist(), times.tolist()))))
    return plan + best_fit_decreasing(left, capacity)


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs a histogram, longest first, each into the fullest open sequences that have room; equal sequences are handled as one group."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, tuple]]] = {}
    done: list[tuple[int, tuple]] = []

    def put(room: int, n: int, what: tuple) -> None:
        if room == 0:
            done.append((n, what))
            return
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((n, what))

    for l in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[l])
        while left:
            at = bisect_left(rooms, l)
            if at == len(rooms):
                each = capacity // l
                if n := left // each:
                    put(capacity - each * l, n, ((l, each),))
                if rest := left % each:
                    put(capacity - rest * l, 1, ((l, rest),))
                break
            room = rooms[at]
            n, what = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = room // l
            full = min(n, left // each)
            if full:
                put(room - each * l, full, (*what, (l, each)))
                left -= full * each
            if full < n:
                if left:
                    put(room - left * l, 1, (*what, (l, left)))
                    left, full = 0, full + 1
                if full < n:
                    put(room, n - full, what)
    done += [x for room in rooms for x in groups[room]]
    return [(n, [*what]) for n, what in done]


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """For each length, runs of its pieces: pieces `first` on (n of them) go to sequences `sequence` on, at `offset`."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for n, what in plan:
        offset = 0
        for l, times in what:
            for _ in range(times):
                first = used.get(l, 0)
                out.append((l, first, n, sequence, offset))
                used[l] = first + n
                offset += l
        sequence += n
    return pd.DataFrame(out, columns=["length", "first", "n", "sequence", "offset"]).sort_values(["length", "first"])


def _pieces(vocab: str, limit: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = word_bpe(vocab)
        task = TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, dtype=np.int64)
        for b in batches:
            doc, none, piece, start, length, crc, rank, ids = [], [], [], [], [], [], [], []
            for d, missing, text in zip(b["doc_id"].tolist(), b["_no_id"].tolist(), b["text"]):
                all_ids = np.append(bpe.encode(text), np.uint32(END)).astype("<u4")
                for k, at in enumerate(range(0, len(all_ids), limit)):
                    part = all_ids[at : at + limit]
                    doc.append(d), none.append(missing), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                    rank.append(int(seen[len(part)]))
                    seen[len(part)] += 1
                    if with_ids:
                        ids.append(part.astype(np.int32))
            out = {"doc_id": ids_back(doc, none), "piece": piece, "start": start, "length": length, "ids_crc32": crc, "_task": task, "_rank": rank}
            if with_ids:
                out["ids"] = ids
            yield pd.DataFrame(out)

    return run


def _place(table: dict[str, np.ndarray], width: int):
    def run(batches):
        # runs of a length start at 0 and follow each other without gaps, so one search over (length, first) finds the run
        keys = table["length"] * width + table["first"]
        for b in batches:
            number = b["_number"].to_numpy(np.int64)
            at = np.searchsorted(keys, b["length"].to_numpy(np.int64) * width + number, side="right") - 1
            b["doc_id"] = ids_back(b["doc_id"], b.pop("_no_id"))
            yield b.assign(sequence_id=table["sequence"][at] + number - table["first"][at], offset=table["offset"][at])

    return run


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = LENGTH, vocab: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    vocab = vocab or vocabulary("word_bpe_49k.json")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _task long, _rank long" + ", ids array<int>" * with_ids
    rows = written(docs.select(*id_columns(doc_id), F.col(text).alias("text")).mapInPandas(_pieces(vocab, limit, with_ids), schema), "pieces")
    by_task = rows.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = written(by_task.select("length", "_task", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "pieces-before")

    counts = np.zeros(limit + 1, dtype=np.int64)
    for r in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # limit rows at most
        counts[r["length"]] = r["n"]
    plan = slots(fit(counts, limit))
    table = {c: plan[c].to_numpy(np.int64) for c in plan.columns}
    numbered = lookup(rows, by_task.drop("_n"), ["length", "_task"]).withColumn("_number", F.col("_before") + F.col("_rank")).drop("_before", "_task", "_rank")
    numbered = numbered.select(*id_columns("doc_id"), *(c for c in numbered.columns if c != "doc_id"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "_number long, sequence_id long, offset long"
    return numbered.mapInPandas(_place(table, int(counts.max()) + 1), schema).drop("_number")


def op4_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))
