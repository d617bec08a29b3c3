"""Operators along time: as-of joins, shifts, tumbling windows, running totals."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import frequency as freq
from ..functions import statistics
from ..plans.meta import Request, frames_between, nearest, spark_type, statistic_dtype, step_of
from ..plans.raster import KEY, Cells, Context, RasterBlock
from .elemwise import BaseSingle


class _Single(BaseSingle):
    def __init__(self, store, *args):
        if not isinstance(store, RasterBlock):
            raise TypeError(f"a raster is needed, not {type(store).__name__}")
        RasterBlock.__init__(self, store, *args)

    bounds = property(lambda self: self.args[0].bounds)
    all_times = property(lambda self: self.args[0].all_times)

    def empty(self, ctx: Context) -> Cells:
        return ctx.leaf(ctx.spark.createDataFrame([], f"t timestamp_ntz, i int, j int, v {spark_type(self.dtype)}"), [])

    def remapped(self, ctx: Context, grid, pairs) -> Cells:
        """The store's cells at other times: pairs of (frame, new time); a frame may serve several."""
        if not pairs:
            return self.empty(ctx)
        used = [a for a, _ in pairs]
        cells = ctx.cells(self.args[0], Request(grid, min(used), max(used)))
        frames = ctx.frames(pairs, ["t", "_to"])
        df = cells.table().join(frames, "t").select(F.col("_to").alias("t"), "i", "j", "v")
        return ctx.leaf(df, sorted(b for _, b in pairs))


class Snap(_Single):
    """The frames of index with the values of the nearest frame of store; a tie goes to the earlier."""

    def __init__(self, store, index):
        if not isinstance(index, RasterBlock):
            raise TypeError("the index is a raster")
        super().__init__(store, index)

    all_times = property(lambda self: self.args[1].all_times if self.args[0].all_times else [])
    timedelta = property(lambda self: self.args[1].timedelta)
    temporal = property(lambda self: self.args[1].temporal)

    def _pairs(self, start, stop):
        return [(nearest(self.args[0].all_times, t), t) for t in self.times(start, stop)]

    def metadata(self, start=None, stop=None):
        pairs = self._pairs(start, stop)
        found = dict(self.args[0].metadata(min(a for a, _ in pairs), max(a for a, _ in pairs))) if pairs else {}
        return [(t, found.get(a)) for a, t in pairs]

    def plan(self, ctx, request):
        return self.remapped(ctx, request.grid, self._pairs(request.start, request.stop))


class Shift(_Single):
    """Later by a timedelta or milliseconds."""

    def __init__(self, store, time):
        super().__init__(store, time if isinstance(time, timedelta) else timedelta(milliseconds=time))

    all_times = property(lambda self: [t + self.args[1] for t in self.args[0].all_times])

    def metadata(self, start=None, stop=None):
        back = [None if t is None else t - self.args[1] for t in (start, stop)]
        return [(t + self.args[1], m) for t, m in self.args[0].metadata(*back)]

    def plan(self, ctx, request):
        by = self.args[1]
        cells = ctx.cells(self.args[0], Request(request.grid, request.start and request.start - by, request.stop and request.stop - by))
        later = F.col("t") + F.make_dt_interval(F.lit(by.days), F.lit(0), F.lit(0), F.lit(by.seconds + by.microseconds / 1e6))
        return ctx.leaf(cells.df.select(later.cast("timestamp_ntz").alias("t"), "i", "j", cells.v.alias("v")), [t + by for t in cells.times])


class TemporalSum(_Single):
    """The sum over all requested frames, at the last of them."""

    dtype = property(lambda self: statistic_dtype(self.args[0].dtype, "sum"))

    def times(self, start=None, stop=None):
        return self.args[0].times(start, stop)[-1:]

    def plan(self, ctx, request):
        found = self.args[0].times(request.start, request.stop)
        if not found:
            return self.empty(ctx)
        cells = ctx.cells(self.args[0], request)
        df = cells.table().groupBy("i", "j").agg(F.sum("v").cast(spark_type(self.dtype)).alias("v"))
        return ctx.leaf(df.withColumn("t", F.lit(found[-1]).cast("timestamp_ntz")), found[-1:])


class TemporalAggregate(_Single):
    """Tumbling windows. Bins without frames are kept: 0 for sum and count, else no data. Without a frequency, one bin over all requested frames, labelled by the last."""

    def __init__(self, source, frequency, statistic="sum", closed=None, label=None, timezone="UTC"):
        statistics.check(statistic, statistics.TEMPORAL)
        for side in (closed, label):
            if side not in (None, "left", "right"):
                raise ValueError("closed and label are 'left' or 'right'")
        if source.dtype == "bool":
            raise TypeError("a boolean raster can't be aggregated")
        super().__init__(source, freq.normalise(frequency), statistic, closed, label, freq.zone(timezone))

    dtype = property(lambda self: statistic_dtype(self.args[0].dtype, self.args[2]))
    temporal = property(lambda self: self.args[1] is not None)
    timedelta = property(lambda self: step_of(self.all_times) if self.args[1] else None)

    def _bins(self):
        times = self.args[0].all_times
        if not times:
            return [], []
        if self.args[1] is None:
            return [times[-1]] * len(times), [times[-1]]
        return freq.bins(times, self.args[1], self.args[3], self.args[4], self.args[5])

    all_times = property(lambda self: self._bins()[1])

    def _members(self, start, stop):
        """(label, frames) of the labels that a request returns."""
        source = self.args[0].all_times
        if self.args[1] is None:
            own = frames_between(source, start, stop) if stop is not None else source
            return [(own[-1], own)] if own else []
        which, _ = self._bins()
        wanted = self.times(start, stop)
        of = {t: [] for t in wanted}
        for t, label in zip(source, which):
            if label in of:
                of[label].append(t)
        return [*of.items()]

    def times(self, start=None, stop=None):
        return [t for t, _ in self._members(start, stop)] if self.args[1] is None else super().times(start, stop)

    def metadata(self, start=None, stop=None):
        found = dict(self.args[0].metadata(*(self.args[0].period or (None, None))))
        return [(label, [found.get(t) for t in own]) for label, own in self._members(start, stop)]

    def plan(self, ctx, request):
        members = self._members(request.start, request.stop)
        pairs = [(t, label) for label, own in members for t in own]
        kind = spark_type(self.dtype)
        parts = []
        if pairs:
            cells = ctx.cells(self.args[0], Request(request.grid, pairs[0][0], pairs[-1][0]))
            rows = cells.table().join(ctx.frames(pairs, ["t", "_label"]), "t")
            parts.append(rows.groupBy(F.col("_label").alias("t"), "i", "j").agg(statistics.grouped(self.args[2], F.col("v")).cast(kind).alias("v")))
        if gaps := [(label,) for label, own in members if not own]:
            zero = F.lit(0 if self.args[2] in ("sum", "count") else None).cast(kind)
            parts.append(ctx.frames(gaps, ["t"]).crossJoin(ctx.window(request.grid)).select(*KEY, zero.alias("v")))
        if not parts:
            return self.empty(ctx)
        df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return ctx.leaf(df, [label for label, _ in members])


class Cumulative(_Single):
    """Running totals by cell, reset at each period; periods close on the right. No data counts as nothing, so the result always has data."""

    def __init__(self, source, statistic="sum", frequency=None, timezone="UTC"):
        if statistic not in ("sum", "count"):
            raise ValueError("a running total is a sum or a count")
        if source.dtype == "bool":
            raise TypeError("a boolean raster can't be accumulated")
        super().__init__(source, statistic, freq.normalise(frequency), freq.zone(timezone))

    dtype = property(lambda self: statistic_dtype(self.args[0].dtype, self.args[1]))

    def plan(self, ctx, request):
        source, wanted = self.args[0].all_times, self.times(request.start, request.stop)
        if not wanted:
            return self.empty(ctx)
        which = freq.bins(source, self.args[2], "right", "right", self.args[3])[0] if self.args[2] else [source[0]] * len(source)
        of = dict(zip(source, which))
        # from the start of the first period, as its total needs that
        pairs = [(t, b) for t, b in of.items() if of[wanted[0]] <= b <= of[wanted[-1]] and t <= wanted[-1]]
        cells = ctx.cells(self.args[0], Request(request.grid, pairs[0][0], pairs[-1][0]))
        rows = cells.table().join(ctx.frames(pairs, ["t", "_bin"]), "t")
        before = Window.partitionBy("i", "j", "_bin").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        total = F.sum(F.coalesce("v", F.lit(0))) if self.args[1] == "sum" else F.count("v")
        rows = rows.withColumn("v", total.over(before).cast(spark_type(self.dtype)))
        return ctx.leaf(rows.filter(F.col("t") >= F.lit(wanted[0]).cast("timestamp_ntz")), wanted)


class Resample(_Single):
    """A regular time axis; each label takes the nearest frame, the last at or before it, or the first at or after it."""

    def __init__(self, source, frequency, direction="nearest", timezone="UTC"):
        if direction not in ("nearest", "backward", "forward"):
            raise ValueError(f"unknown direction {direction!r}")
        super().__init__(source, freq.normalise(frequency), direction, freq.zone(timezone))

    @property
    def all_times(self):
        times = self.args[0].all_times
        return freq.axis(times, self.args[1], self.args[2], self.args[3]) if times else []

    timedelta = property(lambda self: step_of(self.all_times))
    temporal = property(lambda self: True)

    def _pairs(self, start, stop):
        return [(nearest(self.args[0].all_times, t, self.args[2]), t) for t in self.times(start, stop)]

    metadata = Snap.metadata

    def plan(self, ctx, request):
        return self.remapped(ctx, request.grid, self._pairs(request.start, request.stop))
