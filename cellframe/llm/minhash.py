"""Near-dedup beyond the reach of fingerprints: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

At a similarity of 0.8 about 15 % of the bits of two fingerprints differ, 10 of 64, and to meet within 2 of a key's 23 bits would take hundreds of Golay keys a document. So the
Golay keys of simhash.py give the first candidates, which are nearly equal texts, and MinHash gives the others: each set has BANDS keys of ROWS minima; sets of
similarity s share a key with the chance 1 - (1 - s^ROWS)^BANDS, which is 0.99995 at 0.8. Whatever it comes from, a pair is only a candidate: every link is verified on the whole
sets. Equal sets are one node.

In a bucket of up to SMALL nodes all pairs are verified. In a larger one nodes are first verified against a leader of the bucket, for some rounds with
another leader each, and nodes that are linked already, by whatever way, need no more looks at each other. Then all pairs of the
bucket are verified that lie in different components, so that components are those of all candidate pairs. Work is linear where a large bucket is a group
of near copies; it is quadratic only in nodes that share a key and are not similar.

Defined results. A null or empty text has no words: all such are one node without keys. Fewer than five words make one shingle. A null id is kept but never names a
component, unless all its ids are null. An empty table gives an empty table. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import id_columns, ids_back, is_small, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
SMALL = 24
#: Leaders that a large bucket has at most.
ROUNDS = 2


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes, in order."""
    return np.unique(simhash.shingle_hashes(text, shingle))


@lru_cache(1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(simhash.SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
    return a | np.uint64(1), b


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band of a set; none of an empty set."""
    import xxhash

    if not len(found):
        return np.zeros(0, dtype=np.int64)
    a, b = _multipliers()
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), 2048):
        np.minimum(low, (found[None, i : i + 2048] * a + b).min(axis=1), out=low)
    rows = low.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)


def _signatures(shingle: int):
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            node, fp, n, bands = np.zeros(len(b), dtype=np.uint64), np.zeros(len(b), dtype=np.uint64), np.zeros(len(b), dtype=np.int64), []
            for i, t in enumerate(b["text"]):
                hashes = simhash.shingle_hashes(t, shingle)
                fp[i] = simhash.majority(hashes) if len(hashes) else 0
                found = np.unique(hashes)
                node[i], n[i] = xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), simhash.SEED), len(found)
                bands.append(band_keys(found))
            yield pd.DataFrame({"doc_id": ids_back(b["doc_id"], b["_no_id"]), "text_hash": b["text_hash"], "node": node.view(np.int64), "fp": fp.view(np.int64), "n": n, "bands": bands})

    return run


def _sets(shingle: int):
    def run(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                yield pd.DataFrame({"node": part["node"], "items": [shingles(t, shingle).view(np.int64) for t in part["text"]]})

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) those whose sets are similar."""
    left, right = (sets.select(F.col("node").alias(f"_{c}"), F.col("items").alias(f"_set_{c}")) for c in "ab")
    both = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
    common = F.size(F.array_intersect("_set_a", "_set_b"))
    return both.filter(common >= similarity * (F.size("_set_a") + F.size("_set_b") - common) - 1e-9).select("a", "b")


def _pairs(a: DataFrame, b: DataFrame, on: str, similarity: float, apart) -> DataFrame:
    """Distinct pairs of a bucket whose sizes don't rule the similarity out."""
    b = b.select(*(F.col(c) if c == on else F.col(c).alias(f"o_{c}") for c in b.columns))
    met = a.join(b, on).filter(apart & (F.least("n", "o_n") >= similarity * F.greatest("n", "o_n") - 1e-9))
    return met.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def golay_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): candidates by fingerprints: nodes of one fingerprint with the least of them, and the least nodes of fingerprints that Golay keys link."""
    some = nodes.filter("n > 0").select("node", "fp")
    least = written(some.groupBy("fp").agg(F.min("node").alias("least")), "simhash-least")
    same = some.join(least, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    linked = simhash.links(least.select("fp"))
    a, b = (least.select(F.col("fp").alias(f"_{c}"), F.col("least").alias(f"_least_{c}")) for c in "ab")
    near = linked.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b")).select(F.col("_least_a").alias("a"), F.col("_least_b").alias("b"))
    return written(same.unionByName(near), "simhash-pairs")


def links(docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, shingle: int, similarity: float) -> DataFrame:
    """(node, component) as components() gives them, of all verified candidates."""
    keyed = written(nodes.select("node", "n", F.explode("bands").alias("key")), "minhash-keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(keyed.join(sizes, "key"), "minhash-buckets")
    # whole sets only of nodes that have a candidate
    nearly = golay_pairs(nodes)
    wanted = shared.select("node").union(nearly.select("a")).union(nearly.select("b")).select(F.col("node").alias("_node")).distinct().join(nodes, F.col("node") == F.col("_node")).select("node", F.col("at.doc_id").alias("_i"), F.col("at.text_hash").alias("_t"))
    wanted = written(wanted, "minhash-wanted")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(wanted) if is_small(wanted) else wanted, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")))
    # rows that repeat a document repeat its set
    sets = rows.select("node", "text").mapInPandas(_sets(shingle), "node long, items array<long>").groupBy("node").agg(F.first("items").alias("items"))
    sets = written(sets, "minhash-sets")

    few = shared.filter(F.col("size") <= SMALL).select("key", "node", "n")
    pairs = _pairs(few, few, "key", similarity, F.col("node") < F.col("o_node"))
    found = written(verified(nearly.unionByName(pairs).distinct(), sets, similarity), "minhash-links")
    of = components(found)
    live = written(shared.filter(F.col("size") > SMALL).select("key", "node", "n"), "minhash-large")
    for k in range(ROUNDS + 1):
        named = of.select(F.col("node").alias("_node"), "component")
        placed = written(live.join(named, F.col("node") == F.col("_node"), "left").select("key", "node", "n", F.coalesce("component", "node").alias("component")), "minhash-large")
        parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
        # buckets of one component are settled
        parts = written(parts.groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.count(F.lit(1)).alias("parts")).filter("parts > 1"), "minhash-open")
        total, apart = parts.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("squares")) / 2)).first()
        if not total:
            break
        live = placed.join(parts.select(F.col("key").alias("_key")), F.col("key") == F.col("_key"), "left_semi")
        last = k == ROUNDS or apart <= 4 * total
        if last:
            others = live
        else:
            others = live.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(k)), "node", "n", "component")).alias("l")).select("key", "l.node", "l.n", "l.component")
        pairs = _pairs(live, others, "key", similarity, F.col("component") != F.col("o_component"))
        # what is linked so far goes on as one link of each node, which settles sooner
        known = of.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = written(known.unionByName(verified(pairs, sets, similarity)), "minhash-links")
        of = components(found)
        if last:
            break
        live = live.select("key", "node", "n")
    return of


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, text_hash, node (a hash of its set), component (a node), component_id."""
    rows = docs.select(*id_columns(doc_id), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).mapInPandas(_signatures(shingle), "doc_id long, text_hash long, node long, fp long, n long, bands array<long>")
    rows = written(rows, "minhash")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = written(nodes, "minhash-nodes")
    of = links(docs, nodes, text, doc_id, shingle, similarity).withColumnRenamed("node", "_node")
    named = nodes.join(of, F.col("node") == F.col("_node"), "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    named = written(named, "minhash-named")
    ids = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = written(named.join(ids, "component").select(F.col("node").alias("_node"), "component", "component_id"), "minhash-ids")
    return rows.join(named, F.col("node") == F.col("_node")).select("doc_id", "text_hash", "node", "component", "component_id")
