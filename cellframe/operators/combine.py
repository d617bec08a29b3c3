"""Rasters side by side: mosaics and cell-wise statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import statistics
from ..plans.meta import Request, frames_between, regular, spark_type, statistic_dtype
from ..plans.raster import KEY, Cells, Context, RasterBlock, aligned_step, union_times
from .elemwise import BaseElementwise


class BaseCombine(RasterBlock):
    """Period and extent are unions."""

    def __init__(self, *rasters):
        if not rasters or not all(isinstance(r, RasterBlock) for r in rasters):
            raise TypeError("rasters are needed")
        if len({r.dtype == "bool" for r in rasters}) > 1:
            raise TypeError("boolean rasters don't combine with others")
        super().__init__(*rasters)

    @property
    def timedelta(self):
        step = aligned_step(self.args)
        return step if len(self.all_times) > 1 else None

    @property
    def all_times(self):
        times, step = union_times(self.args), aligned_step(self.args)
        # on one regular axis gaps between rasters are frames too, without data
        return regular(times[0], step, (times[-1] - times[0]) // step + 1) if step and times else times

    @property
    def bounds(self):
        out = None
        for r in self.args:
            if r.bounds:
                out = r.bounds.union(out)
        return out

    temporal = property(lambda self: any(r.temporal for r in self.args))

    @property
    def dtype(self):
        import numpy as np

        return str(np.result_type(*(r.dtype for r in self.args)))

    @property
    def projection(self):
        found = {r.projection for r in self.args}
        return found.pop() if len(found) == 1 else None

    def get_relevant_sources(self, start, stop) -> list[RasterBlock]:
        """Those with a frame in the closed interval."""
        return [r for r in self.args if r.all_times and not (r.all_times[0] > stop or r.all_times[-1] < start)]


class Group(BaseCombine):
    """A mosaic in space and time: in each cell the rightmost raster that has data."""

    def metadata(self, start=None, stop=None):
        out = {t: None for t in self.times(start, stop)}
        if out:
            lo, hi = min(out), max(out)
            for r in self.get_relevant_sources(lo, hi):
                out |= {t: m for t, m in r.metadata(lo, hi) if t in out and m not in (None, "")}
        return [*out.items()]

    def plan(self, ctx: Context, request: Request) -> Cells:
        times = self.times(request.start, request.stop)
        kind = spark_type(self.dtype)
        if not times:
            return ctx.leaf(ctx.spark.createDataFrame([], f"t timestamp_ntz, i int, j int, v {kind}"), [])
        parts, covered = [], set()
        for rank, r in enumerate(self.args):
            own = frames_between(r.all_times, times[0], times[-1])
            own = [t for t in own if t in set(times)]
            if own:
                cells = ctx.cells(r, Request(request.grid, own[0], own[-1]))
                parts.append(cells.df.select(*KEY, cells.v.cast(kind).alias("v"), F.lit(rank).alias("rank")))
                covered.update(own)
        gaps = [(t,) for t in times if t not in covered]
        if gaps:
            empty = ctx.frames(gaps, ["t"]).crossJoin(ctx.window(request.grid))
            parts.append(empty.select(*KEY, F.lit(None).cast(kind).alias("v"), F.lit(-1).alias("rank")))
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        if len(parts) > 1:
            df = df.groupBy(*KEY).agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("rank"))).alias("v"))
        return ctx.leaf(df, times)


class Reduce(BaseElementwise):
    """A statistic over rasters, cell by cell, skipping no data. Only frames that all have; the extent is the union."""

    def __init__(self, statistic, *rasters):
        statistics.check(statistic)
        if not rasters or not all(isinstance(r, RasterBlock) for r in rasters):
            raise TypeError("rasters are needed")
        super().__init__(statistic, *rasters)

    @property
    def _kind(self):
        import numpy as np

        return str(np.result_type(*(r.dtype for r in self.rasters)))

    dtype = property(lambda self: statistic_dtype(self._kind, self.args[0]))

    @property
    def bounds(self):
        out = None
        for r in self.rasters:
            if r.bounds:
                out = r.bounds.union(out)
        return out

    def of(self, statistic, *values):
        return statistics.across(statistic, [*values], self._kind)


class Max(Reduce):
    """The greatest value in each cell."""

    def __init__(self, *rasters):
        if rasters and isinstance(rasters[0], str):  # as a view names it
            rasters = rasters[1:]
        super().__init__("max", *rasters)


def reduce_rasters(stack, statistic: str) -> RasterBlock:
    """A statistic over a stack of rasters as a block."""
    return Reduce(statistic, *stack)
