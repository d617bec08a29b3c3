"""Statistics of raster cells inside features, and features burnt into rasters.

A feature is turned into runs of cells along rows, by expressions, and its cells are met by an equi-join on (row, column): no loop over features
and no comparison of all features with all cells. Overlapping features each have cells of their own.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import functions as F

from ..functions import crs as crs_
from ..functions import geometry as geo
from ..functions import statistics
from ..plans.block import setting
from ..plans.geometry import FeatureContext, FeatureRequest, GeometryBlock
from ..plans.meta import EPOCH, Extent, Grid, Request, spark_type
from ..plans.raster import Context, RasterBlock


def zonal_grid(bbox, size: float, crs: str, most: int, auto: bool) -> tuple[Grid, float]:
    """The grid over a box, snapped to multiples of the cell size, and that size: larger than asked if there would be too many cells and auto is set."""
    x1, y1, x2, y2 = bbox
    need = int((x2 - x1) * (y2 - y1) / size**2)
    if need > most:
        if not auto:
            raise RuntimeError(f"{need} cells are more than {most}; use larger cells or auto_pixel_size")
        size *= math.ceil(math.sqrt(need / most))
    x1, y1 = math.floor(x1 / size) * size, math.floor(y1 / size) * size
    x2, y2 = max(math.ceil(x2 / size) * size, x1 + size), max(math.ceil(y2 / size) * size, y1 + size)
    return Grid.from_bbox((x1, y1, x2, y2), max(1, round((x2 - x1) / size)), max(1, round((y2 - y1) / size)), crs), size


class AggregateRaster(GeometryBlock):
    """A column with a statistic of the cells whose centre is inside each feature; of one without any, the cell under its centroid. Several frames give an array in their order."""

    threshold = None

    def __init__(self, source, raster, statistic="sum", projection=None, pixel_size=None, max_pixels=None, column_name="agg", auto_pixel_size=False, *more):
        if not isinstance(source, GeometryBlock) or not isinstance(raster, RasterBlock):
            raise TypeError("features and a raster are needed")
        statistics.check(statistic, statistics.ZONAL)
        projection = crs_.normalise(projection or raster.projection)
        if pixel_size is None:
            if raster.grid is None or not crs_.same(raster.projection, projection):
                raise ValueError("the raster has no cell size in this projection; give one")
            pixel_size = min(raster.grid.dx, raster.grid.dy)
        if pixel_size <= 0:
            raise ValueError("cells have a size")
        super().__init__(source, raster, statistic, projection, float(pixel_size), max_pixels, column_name, bool(auto_pixel_size), *more)

    columns = property(lambda self: self.args[0].columns | {self.args[6]})

    def plan(self, ctx: FeatureContext, request: FeatureRequest):
        source, raster, statistic, crs, size, most, name, auto = self.args[:8]
        spark = ctx.spark
        here = request.projection or source.projection
        features = ctx.features(source, request)
        moved = features.select("fid", geo.transform(F.col("geom"), here, crs).alias("geom"), *([F.col(self.threshold).alias("_limit")] if self.threshold else []))
        b = geo.bounds(F.col("geom"))
        # the only thing that must be known beforehand: how large the grid is
        box = moved.agg(F.min(b["minx"]), F.min(b["miny"]), F.max(b["maxx"]), F.max(b["maxy"])).first()
        times = raster.times(request.start, request.stop)
        kind = "array<float>" if len(times) > 1 else "float"
        zero = 0.0 if statistic in ("sum", "count") else None
        if box[0] is None or not times:
            return features.withColumn(name, F.lit(None if kind != "float" else zero).cast(kind))
        grid, used = zonal_grid(box, size, crs, most or int(setting(spark, "raster-limit")), auto)
        cells = Context(spark).cells(raster, Request(grid, request.start, request.stop)).table().filter("v is not null")
        runs = moved.withColumn("_run", F.explode(geo.cover(F.col("geom"), grid, centroid_cell=True)))
        own = runs.select("fid", *(["_limit"] if self.threshold else []), F.col("_run.i").alias("i"), F.explode(F.sequence("_run.j0", "_run.j1")).alias("j"))
        joined = own.join(cells, ["i", "j"])
        if self.threshold:
            joined = joined.filter(F.col("v") >= F.col("_limit"))
        scale = (used / size) ** 2 if statistic in ("sum", "count") else 1.0
        value = (statistics.grouped(statistic, F.col("v").cast("double")) * F.lit(scale)).cast("float")
        found = joined.groupBy("fid", "t").agg(value.alias("_v"))
        if len(times) == 1:
            found = found.select("fid", F.col("_v").alias(name))
            out = features.drop(name).join(found, "fid", "left")
            return out.withColumn(name, F.coalesce(F.col(name), F.lit(zero).cast("float")))
        per = found.groupBy("fid").agg(F.map_from_entries(F.collect_list(F.struct(F.col("t").cast("string"), "_v"))).alias("_m"))
        out = features.drop(name).join(per, "fid", "left")
        keys = F.array(*(F.lit(t).cast("timestamp_ntz").cast("string") for t in times))
        values = F.transform(keys, lambda t: F.coalesce(F.try_element_at(F.coalesce(F.col("_m"), F.create_map().cast("map<string,float>")), t), F.lit(zero).cast("float")))
        return out.withColumn(name, values).drop("_m")


class AggregateRasterAboveThreshold(AggregateRaster):
    """Only of cells that reach the feature's own threshold; a feature without one has none."""

    def __init__(self, source, raster, statistic="sum", projection=None, pixel_size=None, max_pixels=None, column_name="agg", auto_pixel_size=False, threshold_name=None):
        if threshold_name not in source.columns:
            raise KeyError(f"column {threshold_name!r} isn't there")
        super().__init__(source, raster, statistic, projection, pixel_size, max_pixels, column_name, auto_pixel_size, threshold_name)

    threshold = property(lambda self: self.args[8])


class _Burnt(RasterBlock):
    """Not temporal: one frame at the epoch."""

    all_times = property(lambda self: [EPOCH])
    timedelta = property(lambda self: None)
    temporal = property(lambda self: False)
    grid = property(lambda self: None)
    bounds = property(lambda self: None)

    def metadata(self, start=None, stop=None):
        return [(EPOCH, None)]

    def times(self, start: datetime | None = None, stop: datetime | None = None):
        return [EPOCH]

    def burn(self, ctx, grid, runs, value, kind):
        """Cells of runs (_run, _ord, value), the last in order winning, over the whole window."""
        cells = runs.select("_ord", value.cast(kind).alias("v"), F.col("_run.i").alias("i"), F.explode(F.sequence("_run.j0", "_run.j1")).alias("j"))
        cells = cells.groupBy("i", "j").agg(F.max_by("v", "_ord").alias("v"))
        blank = ctx.window(grid)
        t = F.lit(EPOCH).cast("timestamp_ntz").alias("t")
        v = F.coalesce("v", F.lit(False)) if kind == "boolean" else F.col("v")
        return ctx.leaf(blank.join(cells, ["i", "j"], "left").select(t, "i", "j", v.alias("v")), [EPOCH])


class Rasterize(_Burnt):
    """Features to cells: a column's value, or true where there is a feature. The last feature wins. Features smaller than a cell on all sides go; a limit takes the first ones."""

    def __init__(self, source, column_name=None, dtype=None, limit=None):
        if not isinstance(source, GeometryBlock):
            raise TypeError("features are needed")
        if column_name is not None and column_name not in source.columns | {"fid"}:
            raise KeyError(f"column {column_name!r} isn't there")
        dtype = dtype or ("bool" if column_name is None else "int32" if column_name == "fid" else "float64")
        if spark_type(dtype) == "string":
            raise TypeError("text can't be burnt")
        super().__init__(source, column_name, dtype, limit)

    dtype = property(lambda self: self.args[2])
    projection = property(lambda self: self.args[0].projection)

    def plan(self, ctx: Context, request: Request):
        source, name, dtype, limit = self.args
        grid, kind = request.grid, spark_type(self.dtype)
        box = grid.bbox
        asked = FeatureRequest("intersects", box, crs_.normalise(grid.crs), limit, None if grid.is_point else min(grid.dx, grid.dy))
        features = FeatureContext(ctx.spark).features(source, asked).filter("geom is not null")
        if grid.is_point:
            # the cell is the point itself: the last feature that holds it
            inside = features.filter(geo.contains(F.col("geom"), F.lit(grid.x0), F.lit(grid.y0)) | (F.col("geom.kind") != "polygon"))
            runs = inside.withColumn("_run", F.struct(F.lit(0).alias("i"), F.lit(0).alias("j0"), F.lit(0).alias("j1")))
        else:
            runs = features.withColumn("_run", F.explode(geo.cover(F.col("geom"), grid)))
        if name is None:
            return self.burn(ctx, grid, runs, F.lit(True), kind)
        if features.schema[name].dataType.simpleString() == "boolean":
            return self.burn(ctx, grid, runs.filter(F.col(name)), F.lit(True), kind)
        if features.schema[name].dataType.simpleString() == "string":
            raise TypeError("text can't be burnt")
        value = F.col(name)
        usable = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) != math.inf)
        return self.burn(ctx, grid, runs.filter(usable), value, kind)


class RasterizeWKT(_Burnt):
    """True inside one geometry."""

    def __init__(self, wkt, projection):
        geo.parse_wkt(wkt)
        super().__init__(wkt, crs_.normalise(projection))

    dtype = property(lambda self: "bool")
    projection = property(lambda self: self.args[1])

    @property
    def bounds(self):
        xs, ys = zip(*(p for r in geo.parse_wkt(self.args[0])[1] for p in r))
        return Extent((min(xs), min(ys), max(xs), max(ys)), self.args[1])

    def plan(self, ctx, request):
        grid = request.grid
        geom = geo.transform(geo.from_wkt(self.args[0]), self.args[1], grid.crs)
        x = F.lit(grid.x0) + (F.col("j") + 0.5) * grid.dx
        y = F.lit(grid.y0) - (F.col("i") + 0.5) * grid.dy
        t = F.lit(EPOCH).cast("timestamp_ntz").alias("t")
        return ctx.leaf(ctx.window(grid).select(t, "i", "j", geo.contains(geom, x, y).alias("v")), [EPOCH])


def aggregate_points(features, cells, statistic: str, column: str):
    """(fid, i, j) against cells (t, i, j, v): the value under each point; the count is 1."""
    joined = features.join(cells, ["i", "j"])
    return joined.groupBy("fid", "t").agg(statistics.grouped(statistic, F.col("v").cast("double")).cast("float").alias(column))
