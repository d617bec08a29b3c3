"""Features joined, cut, widened, simplified, measured and tiled."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import crs as crs_
from ..functions import geometry as geo
from ..functions import jts
from ..plans.geometry import FeatureContext, FeatureRequest, GeometryBlock, Series
from .series import SeriesBlock


def _features(*blocks) -> None:
    for b in blocks:
        if not isinstance(b, GeometryBlock):
            raise TypeError(f"features are needed, not {type(b).__name__}")


class MergeGeometryBlocks(GeometryBlock):
    """An equi-join on feature id; columns of both get suffixes, the geometry is the left one's where it has one."""

    def __init__(self, left, right, how="inner", suffixes=("", "_right")):
        _features(left, right)
        if how not in ("inner", "left", "right", "outer"):
            raise ValueError(f"unknown join {how!r}")
        if len(suffixes) != 2 or suffixes[0] == suffixes[1]:
            raise ValueError("two different suffixes are needed")
        super().__init__(left, right, how, [*suffixes])

    @property
    def columns(self):
        (left, right, _, (a, b)) = self.args
        both = left.columns & right.columns
        return {c + a if c in both else c for c in left.columns} | {c + b if c in both else c for c in right.columns}

    def plan(self, ctx, request):
        left, right, how, (a, b) = self.args
        l, r = ctx.features(left, request), ctx.features(right, request)
        both = left.columns & right.columns
        l = l.select("fid", F.col("_ord").alias("_ol"), F.col("geom").alias("_gl"), *(F.col(c).alias(c + a if c in both else c) for c in l.columns if c in left.columns))
        r = r.select("fid", F.col("_ord").alias("_or"), F.col("geom").alias("_gr"), *(F.col(c).alias(c + b if c in both else c) for c in r.columns if c in right.columns))
        out = l.join(r, "fid", how)
        rest = [c for c in out.columns if c not in ("fid", "_ol", "_or", "_gl", "_gr")]
        return out.select("fid", F.coalesce("_ol", "_or").alias("_ord"), F.coalesce("_gl", "_gr").alias("geom"), *rest)

    def extent(self, ctx, request):
        left, right, how, _ = self.args
        if how in ("left", "right"):
            side = left if how == "left" else right
            return side.extent(ctx, request)
        l = left.extent(ctx, request).toDF("a1", "b1", "c1", "d1")
        r = right.extent(ctx, request).toDF("a2", "b2", "c2", "d2")
        low, high = (F.greatest, F.least) if how == "inner" else (F.least, F.greatest)
        both = l.crossJoin(r)  # two single rows
        box = [low("a1", "a2"), low("b1", "b2"), high("c1", "c2"), high("d1", "d2")]
        if how == "inner":
            there = F.col("a1").isNotNull() & F.col("a2").isNotNull() & (box[0] <= box[2]) & (box[1] <= box[3])
            box = [F.when(there, c) for c in box]
        return both.select(*(c.alias(n) for c, n in zip(box, ("minx", "miny", "maxx", "maxy"))))


class Difference(GeometryBlock):
    """Each geometry without that of the feature with the same id in other."""

    def __init__(self, source, other):
        _features(source, other)
        super().__init__(source, other)

    def plan(self, ctx, request):
        source, other = (ctx.features(b, request if k == 0 else replace(request, filters=(), limit=None, geometry=None)) for k, b in enumerate(self.args))
        cut = jts.function(ctx.spark, "difference")
        both = source.join(other.select("fid", F.col("geom").alias("_other")), "fid", "left")
        fresh = F.when(F.col("_other").isNull(), F.col("geom")).otherwise(cut(F.col("geom"), F.col("_other")))
        return both.withColumn("geom", fresh).select(*source.columns)


class Intersection(GeometryBlock):
    """Geometries cut by that of the request; a box needs built-in expressions only."""

    def __init__(self, source, other=None):
        _features(source)
        if other is not None:
            raise NotImplementedError("features are cut by the request's geometry")
        super().__init__(source, other)

    def plan(self, ctx, request):
        df = ctx.features(self.args[0], request)
        if request.geometry is None:
            return df
        if request.is_box:
            fresh = geo.clip_to_box(F.col("geom"), *map(float, request.geometry))
        else:
            fresh = jts.function(ctx.spark, "intersection")(F.col("geom"), geo.literal(*request.rings))
        return df.withColumn("geom", fresh).filter("geom is not null")


class Buffer(GeometryBlock):
    """Geometries widened by a distance in a projection."""

    def __init__(self, source, distance, projection, resolution=16):
        _features(source)
        if resolution < 1:
            raise ValueError("resolution is at least 1")
        super().__init__(source, float(distance), crs_.normalise(projection), int(resolution))

    def plan(self, ctx, request):
        source, distance, crs, resolution = self.args
        df = ctx.features(source, request)
        here = request.projection or source.projection
        wide = jts.function(ctx.spark, "buffer")(geo.transform(F.col("geom"), here, crs), F.lit(distance), F.lit(resolution))
        return df.withColumn("geom", geo.transform(wide, crs, here))

    def extent(self, ctx, request):
        from ..plans.meta import Extent

        source, distance, crs, _ = self.args
        df = source.extent(ctx, request)
        here = request.projection or source.projection
        if crs_.same(here, crs):
            return df.select(*((F.col(c) + (distance if c[:3] == "max" else -distance)).alias(c) for c in ("minx", "miny", "maxx", "maxy")))
        row = df.first()
        if row["minx"] is None:
            return df
        box = Extent(tuple(row), here).transformed(crs).buffered(distance).transformed(here).bbox
        return ctx.spark.createDataFrame([box], "minx double, miny double, maxx double, maxy double")


class Simplify(GeometryBlock):
    """Fewer points within a tolerance: the request's min_size if none is given, else 0."""

    def __init__(self, source, tolerance=None, preserve_topology=True):
        _features(source)
        super().__init__(source, tolerance, bool(preserve_topology))

    def plan(self, ctx, request):
        source, tolerance, keep = self.args
        tolerance = (request.min_size or 0) if tolerance is None else tolerance
        df = ctx.features(source, request)
        return df.withColumn("geom", jts.function(ctx.spark, "simplify")(F.col("geom"), F.lit(float(tolerance)), F.lit(keep)))


class Area(SeriesBlock):
    """The area of each feature in a projection."""

    def __init__(self, source, projection):
        _features(source)
        super().__init__(source, crs_.normalise(projection))

    def series(self, ctx, request):
        source, crs = self.args
        here = request.projection or source.projection
        return Series(ctx.features(source, request), geo.area(geo.transform(F.col("geom"), here, crs)), source.token)


class GeometryTiler(GeometryBlock):
    """A physical hint: features by the tile of their centroid, in the projection asked for. The result is the same; only modes centroid and extent have a tile for each feature."""

    def __init__(self, source, size, projection):
        _features(source)
        if size <= 0:
            raise ValueError("tiles have a size")
        super().__init__(source, float(size), crs_.normalise(projection))

    def plan(self, ctx: FeatureContext, request: FeatureRequest):
        source, size, crs = self.args
        if request.mode == "intersects":
            raise NotImplementedError("tiles know modes centroid and extent")
        df = ctx.features(source, request)
        c = geo.centroid(geo.transform(F.col("geom"), request.projection or source.projection, crs))
        return df.repartition(F.floor(c["x"] / size), F.floor(c["y"] / size))
