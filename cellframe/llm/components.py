"""Connected components of a distributed list of links: each node's smallest reachable id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 64
#: Up to so many links (16 bytes each) are joined by one task, in one pass.
ONE_TASK = 1_000_000


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All links in; (u, v): every node but the smallest of its set, and that smallest."""
    parts = [(b["u"].to_numpy(np.int64), b["v"].to_numpy(np.int64)) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, parent = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        # the smaller root of each link takes the larger one; then every node points at its root
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    tied = parent != np.arange(len(nodes))
    yield pd.DataFrame({"u": nodes[tied], "v": nodes[parent[tied]]})


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link to another; the component is the smallest node that links reach.

    Alternates two steps until nothing changes: every node's larger neighbours are tied to its smallest neighbour, then its smaller ones are. Both
    keep connectivity and shorten paths, so the number of rounds grows with the logarithm of the longest path. Each round's links are
    written to the shared folder; only their number and a checksum reach the driver. Few links (their number is known by then) are joined in one task, with the same result. Null nodes and self links are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    edges = written(edges, "links")
    mark = _mark(edges)
    if mark[0] <= ONE_TASK and dict(edges.dtypes) == {"u": "bigint", "v": "bigint"}:
        edges = written(edges.coalesce(1).mapInPandas(_joined, "u long, v long"), "links")
        mark = (0,)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
