"""Raster sources: arrays, tables of cells, and files."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crs as crs_
from ..plans.meta import Extent, Grid, Request, from_ms, frames_between, is_float, regular, spark_type
from ..plans.raster import KEY, Cells, Context, RasterBlock


class RasterSourceBase(RasterBlock):
    """Reads a window of stored cells: nearest neighbour, no data outside, non-finite values are no data. Subclasses give `stored(spark)`: (t, i, j, v) on their own grid."""

    def _describe(self, grid: Grid | None, first: datetime, delta: timedelta | None, frames: int, dtype: str, dense: bool, metadata=None):
        if frames > 1 and delta is None:
            raise ValueError("more than one frame needs a time_delta")
        if metadata is not None and len(metadata) != frames:
            raise ValueError(f"{len(metadata)} metadata for {frames} frames")
        for k, v in dict(_grid=grid, _times=regular(first, delta, frames), _delta=delta if frames > 1 else None, _dtype=dtype, _dense=dense, _meta=metadata).items():
            object.__setattr__(self, k, v)

    grid = property(lambda self: self._grid)
    all_times = property(lambda self: self._times)
    timedelta = property(lambda self: self._delta)
    dtype = property(lambda self: self._dtype)
    temporal = property(lambda self: self._delta is not None)

    @property
    def bounds(self) -> Extent | None:
        return self._grid.extent if self._grid and self._times else None

    def metadata(self, start=None, stop=None):
        at = {t: k for k, t in enumerate(self._times)}
        return [(t, self._meta[at[t]] if self._meta else None) for t in frames_between(self._times, start, stop)]

    def stored(self, spark) -> DataFrame:
        raise NotImplementedError

    def plan(self, ctx: Context, request: Request) -> Cells:
        grid, times = request.grid, self.times(request.start, request.stop)
        if not times or self._grid is None:
            empty = ctx.spark.createDataFrame([], f"t timestamp_ntz, i int, j int, v {spark_type(self.dtype)}")
            return ctx.leaf(empty, [])
        rows = self.stored(ctx.spark).filter(F.col("t").between(F.lit(times[0]).cast("timestamp_ntz"), F.lit(times[-1]).cast("timestamp_ntz")))
        if is_float(self.dtype):
            rows = rows.withColumn("v", F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v")))
        shift = grid.shifted_from(self._grid)
        if shift is not None:
            di, dj = shift
            inside = rows.filter(F.col("i").between(di, di + grid.height - 1) & F.col("j").between(dj, dj + grid.width - 1))
            inside = inside.select("t", (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), "v")
            covered = di >= 0 and dj >= 0 and di + grid.height <= self._grid.height and dj + grid.width <= self._grid.width
            if not (covered and self._dense):
                inside = self._axis(ctx, times).crossJoin(ctx.window(grid)).join(inside, KEY, "left")
            return ctx.leaf(inside, times)
        # other cells or another projection: each cell asks for the stored one under its centre
        target = ctx.window(grid)
        x = F.lit(grid.x0) + (F.col("j") + 0.5) * grid.dx if not grid.is_point else F.lit(grid.x0)
        y = F.lit(grid.y0) - (F.col("i") + 0.5) * grid.dy if not grid.is_point else F.lit(grid.y0)
        x, y = crs_.transform_columns(x.cast("double"), y.cast("double"), grid.crs, self._grid.crs)
        own = self._grid
        target = target.select("i", "j", F.floor((F.lit(own.y0) - y) / own.dy).cast("int").alias("_i"), F.floor((x - F.lit(own.x0)) / own.dx).cast("int").alias("_j"))
        target = self._axis(ctx, times).crossJoin(target)
        rows = rows.select("t", F.col("i").alias("_i"), F.col("j").alias("_j"), "v")
        return ctx.leaf(target.join(rows, ["t", "_i", "_j"], "left").select(*KEY, "v"), times)

    @staticmethod
    def _axis(ctx: Context, times) -> DataFrame:
        return ctx.frames([(t,) for t in times], ["t"])


class MemorySource(RasterSourceBase):
    """An array (height, width) or (frames, height, width) in memory. time_first and time_delta: milliseconds, or datetime and timedelta."""

    def __init__(self, data, no_data_value, projection, pixel_size, pixel_origin, time_first=0, time_delta=None, metadata=None):
        data = np.asarray(data)
        if data.ndim == 2:
            data = data[None]
        if data.ndim != 3:
            raise ValueError("data has two or three dimensions")
        if data.dtype == np.int64:
            data = data.astype(np.int32)
        dx, dy = (pixel_size, pixel_size) if np.isscalar(pixel_size) else pixel_size
        first = time_first if isinstance(time_first, datetime) else from_ms(time_first)
        delta = time_delta if time_delta is None or isinstance(time_delta, timedelta) else timedelta(milliseconds=time_delta)
        super().__init__(data.tolist(), no_data_value, crs_.normalise(projection), [float(dx), float(dy)], [*map(float, pixel_origin)], first, delta, metadata)
        frames, height, width = data.shape
        grid = Grid(float(pixel_origin[0]), float(pixel_origin[1]), float(dx), abs(float(dy)), width, height, crs_.normalise(projection)) if data.size else None
        self._describe(grid, first, delta, frames, str(data.dtype), True, metadata)
        object.__setattr__(self, "_data", data)

    def stored(self, spark):
        import pyarrow as pa

        n, h, w = self._data.shape
        flat = self._data.ravel()
        none = self.args[1]
        missing = np.zeros(len(flat), bool) if none is None or self.dtype == "bool" else np.isclose(flat, none) if flat.dtype.kind == "f" else flat == none
        if flat.dtype.kind == "f":
            missing |= ~np.isfinite(flat)
        k = np.arange(n * h * w)
        kinds = {"float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
        kind = spark_type(self.dtype)
        values = pa.array([None if m else int(v) for v, m in zip(flat.tolist(), missing)], pa.decimal128(20)) if kind not in kinds else pa.array(flat.astype(np.int64) if flat.dtype.kind == "u" else flat.astype(np.float32) if flat.dtype == np.float16 else flat, mask=missing).cast(kinds[kind])
        table = pa.table({"t": pa.array(np.array(self._times, dtype="datetime64[us]")[k // (h * w)]), "i": (k // w % h).astype(np.int32), "j": (k % w).astype(np.int32), "v": values})
        return spark.createDataFrame(table).select(F.col("t").cast("timestamp_ntz").alias("t"), "i", "j", F.col("v").cast(kind).alias("v"))


class TableSource(RasterSourceBase):
    """A DataFrame with columns t, i, j and v on a regular time axis; cells without a row are no data. With dense=True every cell of the grid has a row in every frame, and none is added."""

    def __init__(self, df: DataFrame, projection: str, pixel_size, pixel_origin, shape, time_first=0, time_delta=None, frames: int = 1, dtype: str = "float64", dense: bool = False):
        dx, dy = (pixel_size, pixel_size) if np.isscalar(pixel_size) else pixel_size
        first = time_first if isinstance(time_first, datetime) else from_ms(time_first)
        delta = time_delta if time_delta is None or isinstance(time_delta, timedelta) else timedelta(milliseconds=time_delta)
        super().__init__(df, projection, pixel_size, list(pixel_origin), list(shape), first, delta, frames, dtype, dense)
        self._describe(Grid(float(pixel_origin[0]), float(pixel_origin[1]), float(dx), float(dy), int(shape[1]), int(shape[0]), crs_.normalise(projection)), first, delta, frames, dtype, dense)

    def stored(self, spark):
        return self.args[0].select(F.col("t").cast("timestamp_ntz").alias("t"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("v").cast(spark_type(self.dtype)).alias("v"))


class ParquetSource(RasterSourceBase):
    """A folder of Parquet cells as RasterFileSink writes it, with its manifest; filters on time and window reach the scan."""

    def __init__(self, url: str):
        from .files import read_manifest

        super().__init__(url)
        m = read_manifest(url)
        self._describe(Grid(*m["grid"]), datetime.fromisoformat(m["first"]), timedelta(seconds=m["delta"]) if m["delta"] else None, m["frames"], m["dtype"], m["dense"])

    def stored(self, spark):
        return spark.read.parquet(f"{self.args[0]}/cells").select(*KEY, "v")


class RasterFileSource(RasterSourceBase):
    """A raster file: ASCII grid (.asc) or GeoTIFF (.tif, uncompressed or deflate). Bands are frames, time_delta milliseconds apart. The header is read on the driver, the values by executors."""

    def __init__(self, url: str, time_first=0, time_delta=300_000):
        from .files import raster_header

        first = time_first if isinstance(time_first, datetime) else from_ms(time_first)
        delta = time_delta if time_delta is None or isinstance(time_delta, timedelta) else timedelta(milliseconds=time_delta)
        super().__init__(url, first, delta)
        h = raster_header(url)
        self._describe(Grid(h.x0, h.y0, h.dx, h.dy, h.width, h.height, h.crs), first, delta if h.bands > 1 else None, h.bands, h.dtype, True)

    def close_dataset(self) -> None:
        """Nothing is held open."""

    def stored(self, spark):
        from .files import raster_cells

        return raster_cells(spark, self.args[0], self._times, spark_type(self.dtype))
