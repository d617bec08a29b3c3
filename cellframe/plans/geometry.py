"""Feature blocks: tables (fid, geom, properties), and series: one column of such a table.

A series keeps the table it comes from; series of one table compose into expressions, and only those of different tables are joined, on fid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs as crs_
from ..functions import geometry as geo
from .block import Block
from .meta import Extent

MODES = ("intersects", "centroid", "extent")
#: Columns that are not properties; _ord is the order of the source, as the last feature wins where they overlap.
OWN = ("fid", "_ord", "geom")


@dataclass(frozen=True)
class FeatureRequest:
    mode: str = "intersects"
    #: WKT or a box, in `projection`; None for everything.
    geometry: object = None
    projection: str | None = None
    limit: float | None = None
    min_size: float | None = None
    filters: tuple = ()
    start: object = None
    stop: object = None

    @property
    def rings(self):
        if self.geometry is None:
            return None
        if isinstance(self.geometry, str):
            return geo.parse_wkt(self.geometry)
        x1, y1, x2, y2 = map(float, self.geometry)
        return ("point", [[(x1, y1)]]) if x1 == x2 and y1 == y2 else ("polygon", geo.box_rings(x1, y1, x2, y2))

    @property
    def box(self) -> Extent | None:
        if self.geometry is None:
            return None
        xs, ys = zip(*(p for r in self.rings[1] for p in r))
        return Extent((min(xs), min(ys), max(xs), max(ys)), self.projection)

    @property
    def is_box(self) -> bool:
        return not isinstance(self.geometry, str)


@dataclass
class Series:
    df: DataFrame
    col: Column
    source: str


@dataclass
class FeatureContext:
    spark: SparkSession
    memo: dict = field(default_factory=dict)

    def features(self, block: GeometryBlock, request: FeatureRequest) -> DataFrame:
        key = (block.token, request)
        if key not in self.memo:
            self.memo[key] = block.plan(self, request)
        return self.memo[key]

    def series(self, block, request: FeatureRequest) -> Series:
        return block.series(self, request)


def chosen(df: DataFrame, request: FeatureRequest, source_crs: str, spark=None, guard: int | None = None) -> DataFrame:
    """What a source does with a request: filters, projection, size, place, limit."""
    for name, value in request.filters:
        if "__" in name:
            raise NotImplementedError(f"only equality filters are known, not {name}")
        if name in df.columns:
            df = df.filter(F.col(name) == F.lit(value))
    target = request.projection or source_crs
    if request.geometry is not None:
        # coarse test on bounds in the source's projection, before anything is computed
        x1, y1, x2, y2 = request.box.transformed(source_crs).bbox
        b = geo.bounds(F.col("geom"))
        df = df.filter((b["minx"] <= x2) & (b["maxx"] >= x1) & (b["miny"] <= y2) & (b["maxy"] >= y1))
    df = df.withColumn("geom", geo.transform(F.col("geom"), source_crs, target))
    b = geo.bounds(F.col("geom"))
    if request.min_size:
        # only features smaller on all sides go
        df = df.filter((b["maxx"] - b["minx"] >= request.min_size) | (b["maxy"] - b["miny"] >= request.min_size))
    if request.geometry is not None:
        x1, y1, x2, y2 = request.box.bbox
        if request.mode == "centroid":
            # half open, so that a feature has one tile
            df = df.withColumn("_c", geo.centroid(F.col("geom")))
            x, y = F.col("_c.x"), F.col("_c.y")
            inside = (x >= x1) & (x < x2) & (y >= y1) & (y < y2) if request.is_box else geo.contains(geo.literal(*request.rings), x, y)
            df = df.filter(inside).drop("_c")
        elif request.is_box:
            hit = F.col("geom.kind") == "point"
            df = df.filter(hit | touches_box(F.col("geom"), x1, y1, x2, y2))
        else:
            df = df.filter(touches(F.col("geom"), geo.literal(*request.rings)))
    if request.limit is not None:
        # an infinite limit asks for everything
        df = df if request.limit == math.inf else df.orderBy("_ord").limit(request.limit)
    elif guard is not None and request.mode != "extent" and len(df.limit(guard + 1).select("fid").take(guard + 1)) > guard:
        raise RuntimeError(f"more than geometry-limit ({guard}) features; ask for a limit (math.inf: all) or a smaller geometry")
    return df


def touches_box(geom: Column, x1, y1, x2, y2) -> Column:
    b = geo.bounds(geom)
    whole = (b["minx"] >= x1) & (b["maxx"] <= x2) & (b["miny"] >= y1) & (b["maxy"] <= y2)
    return whole | touches(geom, geo.literal("polygon", geo.box_rings(x1, y1, x2, y2)))


def touches(geom: Column, other: Column) -> Column:
    """Do two geometries share a point: one holds a point of the other, or edges meet."""
    mine = F.exists(F.flatten(geom["rings"]), lambda p: geo.contains(other, p["x"], p["y"]))
    its = F.exists(F.flatten(other["rings"]), lambda p: geo.contains(geom, p["x"], p["y"]))

    def side(a, b, c):
        return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def meet(e, f):
        p, q, r, s = e["p"], e["q"], f["p"], f["q"]
        across = (side(p, q, r) * side(p, q, s) <= 0) & (side(r, s, p) * side(r, s, q) <= 0)
        near = (F.least(p["x"], q["x"]) <= F.greatest(r["x"], s["x"])) & (F.least(r["x"], s["x"]) <= F.greatest(p["x"], q["x"])) & (F.least(p["y"], q["y"]) <= F.greatest(r["y"], s["y"])) & (F.least(r["y"], s["y"]) <= F.greatest(p["y"], q["y"]))
        return across & near

    edge = F.exists(geo.edges(geom), lambda e: F.exists(geo.edges(other), lambda f: meet(e, f)))
    return F.coalesce(mine | its | edge, F.lit(False))


class GeometryBlock(Block):
    kind = "geometry"

    @property
    def columns(self) -> set[str]:
        """Names of properties, known before anything runs."""
        return self.args[0].columns

    @property
    def projection(self) -> str:
        """What a request without a projection is answered in."""
        return self.args[0].projection

    def plan(self, ctx: FeatureContext, request: FeatureRequest) -> DataFrame:
        raise NotImplementedError

    def extent(self, ctx: FeatureContext, request: FeatureRequest) -> DataFrame:
        b = geo.bounds(F.col("geom"))
        df = ctx.features(self, request).select(*(c.alias(n) for n, c in b.items()))
        return df.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))

    def get_data(self, spark: SparkSession, mode: str = "intersects", geometry=None, projection: str | None = None, limit: float | None = None, min_size: float | None = None, filters: dict | None = None, start=None, stop=None) -> DataFrame:
        """fid, geom and properties; in mode extent one row (minx, miny, maxx, maxy), of nulls if there is nothing. A limit of math.inf asks for everything, whatever geometry-limit is."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        geometry = tuple(geometry) if isinstance(geometry, (list, tuple)) else geometry
        request = FeatureRequest(mode, geometry, crs_.normalise(projection or self.projection), limit, min_size, tuple((filters or {}).items()), start, stop)
        ctx = FeatureContext(spark)
        return self.extent(ctx, request) if mode == "extent" else ctx.features(self, request).drop("_ord")

    def __getitem__(self, name: str):
        from ..operators.series import GetSeriesBlock

        return GetSeriesBlock(self, name)

    def set(self, *pairs):
        from ..operators.series import SetSeriesBlock

        return SetSeriesBlock(self, *pairs)

    def to_file(self, spark: SparkSession, url: str, fields=None, tile_size=None, dry_run: bool = False, **request):
        from ..sources.sinks import write_features

        return write_features(self, spark, url, fields, tile_size, dry_run, **request)


def properties(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in OWN]
