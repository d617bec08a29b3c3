"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a string of BITS bits, one for each of its random hyperplanes, and keeps all strings in a sorted array. A query
descends in every tree to the place of its own string: what lies around it shares the longest prefixes. It then ascends in all trees at once, prefix
by prefix, until the ranges that share the prefix hold enough candidates; only these are compared, by cosine in double precision on the original vectors.

Rows are dealt by hash into index blocks of bounded size, each with a forest of its own that is built once and stored; queries are dealt into blocks
as well, and every query block is put to every index block. Each meeting returns a few rows a query, merged at the end. Inside a block the number
of candidates is doubled until an audit (brute force for a sample of the queries) finds RECALL of the true neighbours; with all rows as candidates it is exact.

Equal vectors are indexed once, with their smallest ids, so a vector that is everywhere costs no more than one.

Defined results. Vectors that are null, empty, zero, or hold a null, NaN or infinity take no part, nor do rows with a null id. Rows that repeat an id and
vector count once; rows that share an id but not the vector are queries of their own, each with its k rows. A query never finds its own id. Vectors of different lengths never meet. Fewer candidates than asked for give
fewer rows. An empty table gives an empty table. Other columns are dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written
from .hnsw import number_type, numbers, unit, usable

NEAREST = 5
TREES = 32
BITS = 48
#: Rows of an index block and queries that are put to it at once; an index block is sent once for so many queries.
BLOCK = 8192
QUERIES = 8192
FIRST = 256
AUDIT = 64
RECALL = 0.97


def planes(dim: int, trees: int, bits: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(trees, bits, dim))


def strings(vectors: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(trees, n) hash strings, as unsigned numbers whose first bit is the highest."""
    weights = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
    out = np.empty((trees, len(vectors)), dtype=np.uint64)
    for t, plane in enumerate(planes(vectors.shape[1], trees, bits)):
        for i in range(0, len(vectors), 4096):
            out[t, i : i + 4096] = ((vectors[i : i + 4096] @ plane.T) > 0) @ weights
    return out


class Forest:
    """Sorted arrays of hash strings; order[t] gives the row of each place in tree t."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS):
        h = strings(vectors, trees, bits)
        self.bits = bits
        self.order = np.argsort(h, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(h, self.order.astype(np.int64), axis=1)

    def ranges(self, h: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trees, n) first and last-plus-one places that share the first `depth` bits (by query) with strings h."""
        tail = (np.uint64(1) << (self.bits - depth).astype(np.uint64)) - np.uint64(1)
        low, high = h & ~tail, h | tail
        lo, hi = np.empty(h.shape, dtype=np.int64), np.empty(h.shape, dtype=np.int64)
        for t in range(len(h)):
            lo[t], hi[t] = np.searchsorted(self.sorted[t], low[t], "left"), np.searchsorted(self.sorted[t], high[t], "right")
        return lo, hi

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the rows of the longest common prefix length at which all trees together hold `enough` (with repeats)."""
        h = strings(queries, len(self.sorted), self.bits)
        # the deepest common level, by halving: counts only grow on the way up
        low, high = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), self.bits, dtype=np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            lo, hi = self.ranges(h, mid)
            ok = (hi - lo).sum(axis=0) >= enough
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        lo, hi = self.ranges(h, low)
        for k in range(len(queries)):
            yield np.unique(np.concatenate([self.order[t, lo[t, k] : hi[t, k]] for t in range(len(h))]))

    def dump(self) -> bytes:
        return zlib.compress(np.array([*self.order.shape, self.bits], "<i8").tobytes() + self.order.astype("<i4").tobytes() + self.sorted.astype("<u8").tobytes(), 1)

    @classmethod
    def load(cls, data: bytes) -> Forest:
        data = zlib.decompress(data)
        trees, n, bits = np.frombuffer(data, "<i8", 3).tolist()
        f = cls.__new__(cls)
        f.bits = bits
        f.order = np.frombuffer(data, "<i4", trees * n, 24).reshape(trees, n)
        f.sorted = np.frombuffer(data, "<u8", trees * n, 24 + 4 * trees * n).reshape(trees, n)
        return f


def nearest(forest: Forest, vectors: np.ndarray, queries: np.ndarray, k: int, audit: int = AUDIT, recall: float = RECALL):
    """For each query (rows, cosines) of its k nearest among the candidates, best first, as many more as tie with the last."""
    def best(q, rows):
        s = vectors[rows] @ q
        if len(rows) > k:
            keep = s >= np.partition(s, -k)[-k]
            rows, s = rows[keep], s[keep]
        order = np.argsort(-s, kind="stable")
        return rows[order], s[order]

    sample = queries[np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int)]
    truth = []
    for q in sample:
        s = vectors @ q
        s = s[s < 1 - 1e-12]  # equal vectors are found anyway
        n = min(k, len(s))
        truth.append((n, np.partition(s, -n)[-n] if n else 2.0))
    enough, most = FIRST, len(vectors) * len(forest.sorted)
    while enough < most:
        got = 0
        for (n, least), q, rows in zip(truth, sample, forest.candidates(sample, enough)):
            s = vectors[rows] @ q
            got += min(n, int(((s >= least - 1e-12) & (s < 1 - 1e-12)).sum()))
        if got >= recall * sum(n for n, _ in truth):
            break
        enough *= 2
    for q, rows in zip(queries, forest.candidates(queries, min(enough, most))):
        yield best(q, rows)


def _pack(key, p: pd.DataFrame) -> pd.DataFrame:
    raw = np.stack(p["v"].to_numpy())
    ids = p["ids"].to_numpy()
    lengths = np.array([len(x) for x in ids], dtype="<i8")
    return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "ids": [np.concatenate(ids).astype("<i8").tobytes()], "lengths": [lengths.tobytes()], "vectors": [raw.tobytes()], "forest": [Forest(unit(raw)).dump()]})


def _cell(k: int):
    def run(key, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(index) and len(asked):
            b = index.iloc[0]
            lengths = np.frombuffer(b["lengths"], "<i8")
            ids, first = np.frombuffer(b["ids"], "<i8"), np.concatenate(([0], np.cumsum(lengths)))
            vectors = unit(numbers(b["vectors"], len(lengths) * int(key[0])).reshape(len(lengths), -1))
            queries = unit(np.stack(asked["v"].to_numpy()))
            forest, own, vector = Forest.load(b["forest"]), asked["vec_id"].to_numpy(), asked["k2"].to_numpy()
            # as many more than asked for as there are vectors under the query's own id
            most = k + asked["own"].to_numpy()
            for m in np.unique(most):
                at = np.flatnonzero(most == m)
                for q, (rows, sims) in zip(at, nearest(forest, vectors, queries[at], int(m))):
                    found = [(-s, i) for r, s in zip(rows.tolist(), sims.tolist()) for i in ids[first[r] : first[r + 1]].tolist() if i != own[q]]
                    out += [(own[q], vector[q], i, min(1.0, -s)) for s, i in sorted(found)[:k]]
        return pd.DataFrame(out, columns=["query_id", "query", "vec_id", "score"])

    return run


def search(rows: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEAREST, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k nearest found among rows, its own id left out."""

    number = "float" if {number_type(rows, embedding), number_type(queries, embedding)} == {"float"} else "double"

    def clean(df):
        v = F.col(embedding).cast(f"array<{number}>")
        df = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
        df = df.withColumn("v", F.transform("v", lambda x: (x + 0.0).cast(number)))
        return df.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))

    # k + 1 ids of a vector suffice; the limit holds in each task before anything is shuffled
    order = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = clean(rows).dropDuplicates(["k1", "k2", "vec_id"]).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    nodes = few.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    nodes = written(nodes.withColumn("dim", F.size("v")), "forest-nodes")
    # how many vectors the id of a query has among the rows
    wanted = clean(queries).select(F.col("vec_id").alias("_q")).distinct()
    own = clean(rows).join(wanted, F.col("vec_id") == F.col("_q"), "left_semi").dropDuplicates(["vec_id", "k1", "k2"]).groupBy("vec_id").agg(F.count(F.lit(1)).cast("int").alias("own"))
    asked = written(clean(queries).dropDuplicates(["vec_id", "k1", "k2"]).join(own, "vec_id", "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("dim", F.size("v")), "forest-queries")
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).join(asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("parts")), "dim")
    sizes = written(sizes, "forest-sizes")  # a row for each length of vectors
    few_sizes = F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes
    dealt = nodes.join(few_sizes, "dim").withColumn("block", F.expr("pmod(k1, blocks)").cast("int"))
    index = written(dealt.groupBy("dim", "block").applyInPandas(_pack, "dim int, block int, ids binary, lengths binary, vectors binary, forest binary"), "forest")
    index = index.join(few_sizes, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts")
    asked = asked.join(few_sizes, "dim").withColumn("part", F.expr("pmod(k2, parts)").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["dim", "block", "part"]
    found = index.groupBy(*key).cogroup(asked.select(*key, "vec_id", "k2", "own", "v").groupBy(*key)).applyInPandas(_cell(k), "query_id long, query long, vec_id long, score double")
    # k rows for each query and index block
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark, sf_dir):
    rows = documents(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.col("vec_id") % 50 == 0))
