"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint has 64 bits; two link at a distance of 2 or less. It is cut into three segments (22, 21 and 21 bits), each read as a
word of the perfect Golay code of length 23. Decoding gives the codewords at distance 4 or less: one, or six when the word is three bits
off its nearest. Two words that differ in at most two bits always share one of these codewords. Of three segments with two errors in all, one
is free of errors and the next has two at most, so linked fingerprints share a key made of a segment's number, its exact bits,
and a codeword index of the next segment.

Equal fingerprints are one node. In a bucket of up to SMALL nodes, pairs are compared and verified. Larger buckets would give pairs
by the square, so their nodes are linked exactly in another way that is linear: every node names itself and its one-bit neighbours, and nodes
that name the same point are within 2 bits of each other, and all that are within 2 bits name a common point; each is tied to the
least of its point.

Defined results. A null or empty text has no words: fingerprint zero, linked like any other. Fewer than three words make one shingle.
Repeated rows share a fingerprint and so a component. A null id is kept but never names a component, unless all its ids are null. An empty
table gives an empty table. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_columns, ids_back, row_back, whole_row, written
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
SMALL = 24
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of so many words, in order; one of all words if there are fewer, none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    flat = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(flat[i:j], SEED) for i, j in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, shingle)
    return majority(hashes) if len(hashes) else 0


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536, None].astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


@lru_cache(1)
def codewords() -> np.ndarray:
    """The 4,096 codewords by index: data bits times the generator."""
    data = np.arange(4096, dtype=np.int64)
    out = np.zeros(4096, dtype=np.int64)
    for k in range(12):
        out ^= np.where(data >> k & 1, GENERATOR << k, 0)
    return out


@lru_cache(1)
def decoder() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of weight 3 or less, and the six indices that its radius-4 codewords add to the nearest (padded by the nearest itself)."""
    words = codewords()
    weights = np.array([bin(w).count("1") for w in words])
    near = [(int(w), i) for i, w in enumerate(words) if weights[i] in (7, 8) or i == 0]
    errors, extra = np.zeros(2048, dtype=np.int64), np.zeros((2048, 6), dtype=np.int64)
    bits = [1 << k for k in range(23)]
    patterns = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    sevens = [(w, i) for w, i in near if bin(w).count("1") == 7]
    for e in patterns:
        s = int(syndrome(np.array([e]))[0])
        errors[s] = e
        if bin(e).count("1") == 3:
            # a heptad that holds the three bits is four away
            extra[s] = [0, *(i for w, i in sevens if w & e == e)]
    return errors, extra


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder by the generator."""
    r = words.astype(np.int64).copy()
    for k in range(22, 10, -1):
        r ^= np.where(r >> k & 1, GENERATOR << (k - 11), 0)
    return r


def quotient(words: np.ndarray) -> np.ndarray:
    """Index of codewords: division by the generator."""
    r, q = words.astype(np.int64).copy(), np.zeros(len(words), dtype=np.int64)
    for k in range(22, 10, -1):
        hit = r >> k & 1
        q |= hit << (k - 11)
        r ^= np.where(hit, GENERATOR << (k - 11), 0)
    return q


def golay_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within distance 4; with repeats where there is one only."""
    errors, extra = decoder()
    s = syndrome(words)
    # the code is linear: indices around a word are those around its error, moved by its nearest codeword
    return quotient(words ^ errors[s])[:, None] ^ extra[s]


def keys(fingerprints: np.ndarray) -> np.ndarray:
    """(n, 18) keys of unsigned 64-bit fingerprints: 2 bits of segment number, its bits, 12 bits of the next one's index."""
    f = fingerprints.astype(np.uint64)
    parts = [((f >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    return np.concatenate([(k << 34 | parts[k] << 12)[:, None] | golay_indices(parts[(k + 1) % 3]) for k in range(3)], axis=1)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": ids_back(b["doc_id"], b["_no_id"]), "text_hash": b["text_hash"], "fp": f.view(np.int64)})

    return run


def _keys(batches):
    for b in batches:
        f = b["fp"].to_numpy(np.int64)
        k = keys(f.view(np.uint64))
        out = pd.DataFrame({"key": k.ravel(), "fp": np.repeat(f, k.shape[1])})
        yield out.drop_duplicates()


def _points(batches):
    flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    for b in batches:
        f = b["fp"].to_numpy(np.int64).view(np.uint64)
        for i in range(0, len(f), 4096):
            part = f[i : i + 4096]
            yield pd.DataFrame({"point": (part[:, None] ^ flips).ravel().view(np.int64), "fp": np.repeat(part, 65).view(np.int64)})


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp, written) that have the same components as all links of RADIUS bits."""
    keyed = written(nodes.mapInPandas(_keys, "key long, fp long"), "golay")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed.join(sizes, "key")
    # pairs inside small buckets only: at most SMALL rows meet a row
    few = shared.filter(F.col("n") <= SMALL).select("key", "fp")
    pairs = few.join(few.withColumnRenamed("fp", "other"), "key").filter((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    many = shared.filter(F.col("n") > SMALL).select("fp").distinct()
    points = many.mapInPandas(_points, "point long, fp long")
    low = points.groupBy("point").agg(F.min("fp").alias("low"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    stars = low.select(F.col("low").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, text_hash, fp (the fingerprint as a signed long), component (a fingerprint), component_id."""
    rows = docs.select(*id_columns(doc_id), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).mapInPandas(_fingerprints(shingle), "doc_id long, text_hash long, fp long")
    rows = written(rows, "simhash")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    of = components(links(nodes.select("fp")))
    named = nodes.join(of, nodes["fp"] == of["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = written(named.join(ids, "component").select(F.col("fp").alias("_fp"), "component", "component_id"), "simhash-ids")
    return rows.join(named, rows["fp"] == named["_fp"]).select("doc_id", "text_hash", "fp", "component", "component_id")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """docs without all but one row of each component: the one with the smallest id (a null id only if there is no other).

    Without a similarity, fingerprints within RADIUS bits are linked; with one, documents whose sets of shingles are that similar, verified on the whole sets.
    """
    if similarity is None:
        return one_of_each(docs, near_duplicates(docs, text, doc_id, shingle), text, doc_id)
    from . import minhash

    return one_of_each(docs, minhash.near_duplicates(docs, text, doc_id, shingle, similarity), text, doc_id)


def one_of_each(docs: DataFrame, found: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows that stand for the components that near_duplicates found."""
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("_best"))
    # how many rows repeat the id and text of the one that stays
    ids = best.select(F.col("_best.doc_id").alias("_id"), F.col("_best.text_hash").alias("_th")).distinct()
    ids = written(ids, "simhash-kept")
    rows = docs.select(whole_row(docs), F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_th"))
    kept = rows.join(ids.select(F.col("_id").alias("_i"), F.col("_th").alias("_t")), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left_semi")
    repeats = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeats.isEmpty():
        kept = kept.dropDuplicates(["_id", "_th"])
    return kept.select(*row_back(docs.columns))


def op7_simhash(spark, sf_dir):
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
