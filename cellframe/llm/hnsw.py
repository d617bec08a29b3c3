"""Embedding near-dedup by hierarchical navigable small-world graphs, one per shard.

Vectors are compared only inside a label. Equal vectors of a label are one node with a count, so a vector that is everywhere costs one node. The nodes of
a label are dealt by hash into shards of bounded size; each shard gets a layered graph (every node linked to near and diverse
others, a few nodes on upper layers), built once and stored as bytes. Every node then searches every shard of its label, in blocks of bounded size: a beam
walks each graph, and is doubled for a query as long as its worst hit is still within the threshold, as there may be more. Beams for all are widened until
an audit, brute force over queries drawn until enough true links to others are seen, finds that the required recall has been met (a beam as wide as the shard is exhaustive). Hits
are verified in double precision on the original vectors, so there is no false link.

Every shard of a label is asked for every node of it, so work and traffic grow with the square of a label's shards: labels should be far smaller than the table. n_links
counts what a vector's own searches found.

A task returns counts, and for unions only the links that its own union-find needed: at most one for each node it saw.

Defined results. Vectors that are null, empty, zero, or hold a null, NaN or infinity, and rows with a null label, link with nothing. Vectors of different
lengths don't link. Repeated vectors, whatever their ids, link to each other. A row with a null vec_id takes part in counts and is its own component. Rows with the same id
share that id's component. An empty table gives an empty table. Other columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, lookup, written
from .components import components

THRESHOLD = 0.98
#: Nodes of a shard and queries of a block, about; fewer if vectors are so long that they pass SHARD_BYTES. A graph is sent once for each block: smaller blocks are
#: more tasks of a large label, larger ones less traffic.
SHARD = 8192
BLOCK = 2048
SHARD_BYTES = 64 << 20
LINKS = 12
BUILD_BEAM = 40
BEAM = 24
#: Audits go on until they saw so many true links, or all queries of the block.
AUDIT = 64
RECALL = 0.999


class Graph:
    """A layered small-world graph over unit vectors. Built in batches: each batch searches what is there, then links to it both ways."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 1):
        n = len(vectors)
        self.v = vectors.astype(np.float32)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n)) / np.log(links)).astype(int), 6)
        order = np.argsort(-level, kind="stable")
        self.v = self.v[order]
        #: position -> row of `vectors`
        self.rows = order
        level = level[order]
        # nodes of a layer are a prefix, as they are ordered by level
        self.sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1)] if n else []
        self.layers = [np.full((size, (2 if k == 0 else 1) * links), -1, dtype=np.int32) for k, size in enumerate(self.sizes)]
        for k in range(len(self.sizes) - 1, -1, -1):
            self._build(k, links, beam)

    def _build(self, k: int, links: int, beam: int) -> None:
        size, net = self.sizes[k], self.layers[k]
        done = self.sizes[k + 1] if k + 1 < len(self.sizes) else 1
        if k + 1 < len(self.sizes):
            # the layer above is a good start
            net[:done, : self.layers[k + 1].shape[1]] = self.layers[k + 1]
        while done < size:
            now = np.arange(done, min(size, done + max(8, min(512, done))))
            start = self._descend(self.v[now], k)
            ids, sims = self._search(self.v[now], start, net, done, min(beam, done))
            # those of the batch see each other too
            own = self.v[now] @ self.v[now].T
            own[np.arange(len(now)), np.arange(len(now))] = -2
            near = min(len(now), 8)
            close = np.argpartition(-own, near - 1, axis=1)[:, :near]
            ids = np.concatenate((ids, now[close]), axis=1)
            sims = np.concatenate((sims, np.take_along_axis(own, close, axis=1)), axis=1)
            sims[ids < 0] = -2
            chosen = self._diverse(ids, sims, links)
            net[now, : chosen.shape[1]] = chosen
            self._back(net, now, chosen)
            done = int(now[-1]) + 1

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """For each row up to m candidates, nearest first, of which none is nearer to a chosen one than to the row itself; the rest filled with the nearest left."""
        at = np.argsort(-sims, axis=1, kind="stable")[:, : max(3 * m, 32)]
        ids, sims = np.take_along_axis(ids, at, axis=1), np.take_along_axis(sims, at, axis=1)
        vecs = self.v[np.maximum(ids, 0)]
        between = np.matmul(vecs, vecs.transpose(0, 2, 1))
        n, c = ids.shape
        out, count = np.full((n, m), -1, dtype=np.int32), np.zeros(n, dtype=int)
        taken = np.zeros((n, c), dtype=bool)
        worst = np.full((n, c), -2.0, dtype=np.float32)  # nearest chosen one
        for fill in (False, True):
            for j in range(c):
                ok = (sims[:, j] > -2) & (count < m) & ~taken[:, j] & (fill | (worst[:, j] < sims[:, j]))
                r = np.flatnonzero(ok)
                if len(r):
                    out[r, count[r]] = ids[r, j]
                    count[r] += 1
                    taken[r, j] = True
                    worst[r] = np.maximum(worst[r], between[r, j])
        return out

    def _back(self, net: np.ndarray, now: np.ndarray, chosen: np.ndarray) -> None:
        """Links from the chosen ones back; a full list is chosen anew."""
        to, frm = chosen.ravel(), np.repeat(now, chosen.shape[1])
        frm, to = frm[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        nodes, first, n = np.unique(to, return_index=True, return_counts=True)
        most = net.shape[1] + int(n.max())
        ids = np.full((len(nodes), most), -1, dtype=np.int64)
        ids[:, : net.shape[1]] = net[nodes]
        ids[np.repeat(np.arange(len(nodes)), n), net.shape[1] + np.arange(len(to)) - np.repeat(first, n)] = frm
        for i in range(0, len(nodes), 1024):
            part, own = ids[i : i + 1024], nodes[i : i + 1024]
            # the same neighbour once
            part.sort(axis=1)
            part[:, 1:][part[:, 1:] == part[:, :-1]] = -1
            sims = np.einsum("nd,ncd->nc", self.v[own], self.v[np.maximum(part, 0)])
            sims[part < 0] = -2
            net[own] = self._diverse(part, sims, net.shape[1])

    def _descend(self, q: np.ndarray, layer: int) -> np.ndarray:
        """Nearest node found on the layers above, one for each query."""
        at = np.zeros(len(q), dtype=np.int64)
        for k in range(len(self.sizes) - 1, layer, -1):
            best = np.einsum("nd,nd->n", q, self.v[at])
            moving = np.arange(len(q))
            while len(moving):
                near = self.layers[k][at[moving]]
                sims = np.einsum("nd,ncd->nc", q[moving], self.v[np.maximum(near, 0)])
                sims[near < 0] = -2
                j = sims.argmax(axis=1)
                top = sims[np.arange(len(moving)), j]
                up = top > best[moving]
                moving, near, j, top = moving[up], near[up], j[up], top[up]
                at[moving], best[moving] = near[np.arange(len(moving)), j], top
        return at

    def _search(self, q: np.ndarray, start: np.ndarray, net: np.ndarray, size: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search on one layer for many queries at once: (n, beam) positions (-1: none) and cosines, best first."""
        n = len(q)
        ids, sims = np.full((n, beam), -1, dtype=np.int64), np.full((n, beam), -2.0, dtype=np.float32)
        open_ = np.zeros((n, beam), dtype=bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("nd,nd->n", q, self.v[start]), True
        seen = np.zeros((n, size), dtype=bool)
        seen[np.arange(n), start] = True
        live = np.arange(n)
        width = 2  # nodes that each query opens in a step
        while len(live):
            score = np.where(open_[live], sims[live], -3)
            pick = np.argsort(-score, axis=1)[:, :width] if beam > 1 else np.zeros((len(live), 1), dtype=int)
            can = np.take_along_axis(score, pick, axis=1) > -3
            keep = can[:, 0]
            live, pick, can = live[keep], pick[keep], can[keep]
            if not len(live):
                break
            open_[live[:, None], pick] = False
            node = np.where(can, ids[live[:, None], pick], -1)
            near = np.where((node < 0)[:, :, None], -1, net[np.maximum(node, 0)]).reshape(len(live), -1)
            near = np.where(near < size, near, -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[near >= 0] = np.where(seen[np.repeat(live, near.shape[1]).reshape(near.shape)[near >= 0], near[near >= 0]], -1, near[near >= 0])
            r, c = np.nonzero(near >= 0)
            seen[live[r], near[r, c]] = True
            s = np.full(near.shape, -2.0, dtype=np.float32)
            s[r, c] = np.einsum("nd,nd->n", q[live[r]], self.v[near[r, c]])
            all_s = np.concatenate((sims[live], s), axis=1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(all_s, top, axis=1)
            ids[live] = np.take_along_axis(np.concatenate((ids[live], near), axis=1), top, axis=1)
            open_[live] = np.take_along_axis(np.concatenate((open_[live], near >= 0), axis=1), top, axis=1)
        ids[sims <= -2] = -1
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, beam) rows of the vectors it was built from (-1: none) and cosines, best first."""
        size = self.sizes[0]
        beam = min(beam, size)
        q = q.astype(np.float32)
        out_i, out_s = np.empty((len(q), beam), dtype=np.int64), np.empty((len(q), beam), dtype=np.float32)
        if beam == size:
            for i in range(0, len(q), 1024):
                sims = q[i : i + 1024] @ self.v.T
                at = np.argsort(-sims, axis=1, kind="stable")
                out_i[i : i + 1024], out_s[i : i + 1024] = self.rows[at], np.take_along_axis(sims, at, axis=1)
            return out_i, out_s
        for i in range(0, len(q), 512):
            part = q[i : i + 512]
            ids, sims = self._search(part, self._descend(part, 0), self.layers[0], size, beam)
            out_i[i : i + 512], out_s[i : i + 512] = np.where(ids < 0, -1, self.rows[np.maximum(ids, 0)]), sims
        return out_i, out_s

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), self.v.shape[1], *self.sizes, *(x.shape[1] for x in self.layers)], dtype="<i8")
        return zlib.compress(b"".join([np.int64(len(head)).tobytes(), head.tobytes(), self.rows.astype("<i8").tobytes(), *(x.astype("<i4").tobytes() for x in self.layers)]), 1)

    @classmethod
    def load(cls, data: bytes, vectors: np.ndarray) -> Graph:
        data = zlib.decompress(data)
        k = int(np.frombuffer(data, "<i8", 1)[0])
        head = np.frombuffer(data, "<i8", k, 8)
        g, n = cls.__new__(cls), int(head[0])
        g.sizes, widths, at = head[2 : 2 + n].tolist(), head[2 + n :], 8 + 8 * k
        size = g.sizes[0] if n else 0
        g.rows = np.frombuffer(data, "<i8", size, at)
        at += 8 * size
        g.layers = []
        for s, w in zip(g.sizes, widths.tolist()):
            g.layers.append(np.frombuffer(data, "<i4", s * w, at).reshape(s, w))
            at += 4 * s * w
        g.v = vectors[g.rows].astype(np.float32)
        return g


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that no square overflows or vanishes."""
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _pairs(graph: Graph, queries: np.ndarray, beam: int, near: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) of hits with at least about `near`; a query whose whole beam is that near is asked again with twice the beam."""
    size = graph.sizes[0]
    for i in range(0, len(queries), 512):
        asked, width = np.arange(i, min(i + 512, len(queries))), min(beam, size)
        while len(asked):
            step = max(8, min(512, 2_000_000 // width))
            again = []
            for j in range(0, len(asked), step):
                part = asked[j : j + step]
                rows, sims = graph.search(queries[part], width)
                full = (sims[:, -1] >= near) & (width < size)
                r, c = np.nonzero((sims >= near) & (rows >= 0) & ~full[:, None])
                yield part[r], rows[r, c]
                again.append(part[full])
            asked, width = np.concatenate(again), min(size, width * 2)


def audited(vectors: np.ndarray, queries: np.ndarray, threshold: float, own: np.ndarray, links: int = AUDIT) -> tuple[np.ndarray, np.ndarray]:
    """(sample, truth): some of the queries and, by brute force, which vectors each links to, itself (row `own`, -1: not among them) left out. As many
    queries as it takes to see `links` true links, or all."""
    order = np.random.default_rng(5).permutation(len(queries))
    taken, truth, seen = [], [], 0
    for i in range(0, len(order), 256):
        part = order[i : i + 256]
        near = queries[part] @ vectors.T >= threshold
        mine = np.flatnonzero(own[part] >= 0)
        near[mine, own[part][mine]] = False
        linked = near.any(axis=1)
        taken.append(part[linked])
        truth.append(near[linked])
        seen += int(near.sum())
        if seen >= links:
            break
    return np.concatenate(taken), np.concatenate(truth)


def within(graph: Graph, vectors: np.ndarray, queries: np.ndarray, threshold: float, own: np.ndarray, audit: int = AUDIT, recall: float = RECALL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) arrays of the pairs found with a cosine of at least the threshold in double precision, each once."""
    beam, near = BEAM, threshold - 1e-5
    sample, truth = audited(vectors, queries, threshold, own, audit)
    while beam < len(vectors) and len(sample):
        hit = np.zeros_like(truth)
        for q, at in _pairs(graph, queries[sample], beam, near):
            hit[q, at] = True
        if (hit & truth).sum() >= recall * truth.sum():
            break
        beam *= 2
    for q, at in _pairs(graph, queries, beam, near):
        for i in range(0, len(q), 200_000):
            a, b = q[i : i + 200_000], at[i : i + 200_000]
            ok = np.einsum("nd,nd->n", queries[a], vectors[b]) >= threshold
            yield a[ok], b[ok]


class Forest:
    """Union-find over arrays; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        at = self.parent[at]
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            at = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def numbers(data: bytes, count: int) -> np.ndarray:
    """So many floats of whatever width fills the bytes."""
    return np.frombuffer(data, "<f4" if len(data) == 4 * count else "<f8")


def number_type(rows: DataFrame, column: str) -> str:
    """float for vectors of floats, which are sent as they are; else double. Cosines are taken in double precision either way."""
    kind = rows.schema[column].dataType
    return "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"


def _pack_shard(key, p: pd.DataFrame) -> pd.DataFrame:
    p = p.sort_values("node")
    raw = np.stack(p["v"].to_numpy())
    graph = Graph(unit(raw))
    return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "blocks": [p["blocks"].iloc[0]], "nodes": [p["node"].to_numpy("<i8").tobytes()], "n": [p["n"].to_numpy("<i8").tobytes()], "vectors": [raw.tobytes()], "graph": [graph.dump()]})


def _cell(threshold: float):
    def run(key, shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return pd.DataFrame({"node": [], "links": [], "other": []})
        s, dim = shard.iloc[0], int(key[1])
        nodes, n = np.frombuffer(s["nodes"], "<i8"), np.frombuffer(s["n"], "<i8")
        vectors = unit(numbers(s["vectors"], len(nodes) * dim).reshape(-1, dim))
        graph = Graph.load(s["graph"], vectors)
        block = block.sort_values("node")
        mine, queries = block["node"].to_numpy(np.int64), unit(np.stack(block["v"].to_numpy()))
        links = np.zeros(len(mine), dtype=np.int64)
        # one number for each node, in order of nodes, so that roots are smallest nodes
        every, at = np.unique(np.concatenate((mine, nodes)), return_inverse=True)
        forest = Forest(len(every))
        place = np.minimum(np.searchsorted(nodes, mine), len(nodes) - 1)
        for q, r in within(graph, vectors, queries, threshold, np.where(nodes[place] == mine, place, -1)):
            other = mine[q] != nodes[r]
            q, r = q[other], r[other]
            links += np.bincount(q, weights=n[r], minlength=len(mine)).astype(np.int64)
            forest.join(at[q], at[len(mine) + r])
        root = every[forest.roots(np.arange(len(every)))]
        tied = root != every
        return pd.DataFrame({"node": np.concatenate((mine, every[tied])), "links": np.concatenate((links, np.zeros(tied.sum(), np.int64))), "other": pd.array([None] * len(mine) + root[tied].tolist(), dtype="Int64")})

    return run


def usable(v):
    """Not null, empty or zero, and without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    number = number_type(rows, embedding)
    v = F.col(embedding).cast(f"array<{number}>")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    rows = rows.withColumn("v", F.when(F.col("label").isNotNull() & usable(F.col("v")), F.transform("v", lambda x: (x + 0.0).cast(number))))
    # two hashes, 128 bits, stand for a label and vector
    rows = written(rows.withColumn("k1", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v"))).withColumn("k2", F.when(F.col("v").isNotNull(), F.xxhash64("v", "label", F.lit(1)))), "vectors")
    nodes = rows.filter("v is not null").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))
    nodes = written(nodes.withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    sizes = written(nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("_size")), "vector-labels")
    placed = nodes.join(F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes, ["label", "dim"])
    fits = F.ceil(F.lit(float(SHARD_BYTES)) / (8 * F.col("dim")))
    placed = placed.withColumn("shards", F.ceil(F.col("_size") / F.least(F.lit(shard), fits)).cast("int")).withColumn("blocks", F.ceil(F.col("_size") / F.least(F.lit(block), fits)).cast("int"))
    placed = placed.select("label", "dim", "node", "n", "v", "shards", "blocks", F.expr("pmod(k1, shards)").cast("int").alias("shard"), F.expr("pmod(k2, blocks)").cast("int").alias("block"))

    graphs = placed.groupBy("label", "dim", "shard").applyInPandas(_pack_shard, "label string, dim int, shard int, blocks int, nodes binary, n binary, vectors binary, graph binary")
    graphs = written(graphs, "hnsw").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    queries = placed.select("label", "dim", "node", "v", "block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    key = ["label", "dim", "shard", "block"]
    found = graphs.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(_cell(threshold), "node long, links long, other long")
    found = written(found, "vector-links")

    of = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("k1", "k2", "node", "n", "low").join(links, "node").join(of.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = written(named.select("k1", "k2", (F.col("links") + F.col("n") - 1).alias("links"), "low", F.coalesce("component", "node").alias("component")), "vector-named")
    ids = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = written(named.join(ids, "component").select("k1", "k2", "links", "component_id"), "vector-ids")
    out = lookup(rows.select("vec_id", "k1", "k2"), named, ["k1", "k2"])
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_embedding_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir, "embeddings"))


#: All pairs inside a label, in DuckDB's SQL; for tables small enough for that.
OP9_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (
  SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a)
SELECT e.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = e.vec_id) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM e JOIN m ON e.vec_id = m.a
"""
