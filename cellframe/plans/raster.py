"""Raster blocks. A window of a raster is a table of cells (t, i, j, v): frame, row, column, value; NULL is no data, and no cell of the window is missing.

A block plans into Cells: a table and an expression over it. Blocks over the same table, as most algebra is, compose expressions and never
join; only rasters from different tables are joined, on (t, i, j). A plan's memo makes equal (block, request) pairs one table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .block import Block, setting
from .meta import Extent, Grid, Request, dtype_max, frames_between, spark_type

KEY = ["t", "i", "j"]


@dataclass
class Cells:
    df: DataFrame
    v: Column
    #: Frames in the table, in order.
    times: list[datetime]
    #: Tables of equal source are the same object, whatever the expression.
    source: str

    def table(self, *more: str) -> DataFrame:
        return self.df.select(*KEY, self.v.alias("v"), *more)


@dataclass
class Context:
    spark: SparkSession
    memo: dict = field(default_factory=dict)
    count: int = 0

    def name(self) -> str:
        self.count += 1
        return f"v{self.count}"

    def cells(self, block: RasterBlock, request: Request) -> Cells:
        key = (block.token, request)
        if key not in self.memo:
            self.memo[key] = block.plan(self, request)
        return self.memo[key]

    def leaf(self, df: DataFrame, times: list[datetime], source: str | None = None) -> Cells:
        """Cells of a table (t, i, j, v); its value column gets a name of its own, so that tables can be joined."""
        n = self.name()
        return Cells(df.select(*KEY, F.col("v").alias(n)), F.col(n), times, source or n)

    def join(self, *parts: Cells, how: str = "inner") -> list[Cells]:
        """The same cells over one table."""
        first = parts[0]
        done = {first.source: (first.df, None)}
        df, source = first.df, first.source
        for p in parts[1:]:
            if p.source not in done:
                df = df.join(p.df, KEY, how)
                done[p.source] = None
        source = "+".join(sorted(done)) if how == "inner" else self.name()
        times = sorted(set(first.times).intersection(*(p.times for p in parts))) if how == "inner" else first.times
        return [Cells(df, p.v, times, source) for p in parts]

    def frames(self, pairs: list[tuple[datetime, ...]], names: list[str]) -> DataFrame:
        """A small table of frames; there are at most raster-limit-timesteps of them, so it can be broadcast."""
        most = int(setting(self.spark, "raster-limit-timesteps"))
        if len(pairs) > most:
            raise RuntimeError(f"{len(pairs)} frames are more than raster-limit-timesteps ({most})")
        schema = ", ".join(f"{n} timestamp_ntz" for n in names)
        return F.broadcast(self.spark.createDataFrame(pairs, schema))

    def window(self, grid: Grid) -> DataFrame:
        """(i, j) of all cells of a grid, made on the executors."""
        return self.spark.range(grid.height).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))))


class RasterBlock(Block):
    kind = "raster"
    #: Attributes every raster has.
    ATTRIBUTES = ("period", "timedelta", "extent", "dtype", "fillvalue", "geometry", "projection", "geo_transform", "temporal")

    # --- what subclasses say ---
    @property
    def store(self) -> RasterBlock:
        """The raster that metadata come from."""
        return next(a for a in self.args if isinstance(a, RasterBlock))

    def times(self, start: datetime | None = None, stop: datetime | None = None) -> list[datetime]:
        """The frames that a request for (start, stop) returns."""
        return frames_between(self.all_times, start, stop)

    @property
    def all_times(self) -> list[datetime]:
        return self.store.all_times

    @property
    def timedelta(self) -> timedelta | None:
        return self.store.timedelta

    @property
    def bounds(self) -> Extent | None:
        """Extent in the raster's own projection."""
        return self.store.bounds

    @property
    def grid(self) -> Grid | None:
        return self.store.grid

    @property
    def dtype(self) -> str:
        return self.store.dtype

    @property
    def temporal(self) -> bool:
        return self.store.temporal

    def plan(self, ctx: Context, request: Request) -> Cells:
        raise NotImplementedError

    def metadata(self, start: datetime | None = None, stop: datetime | None = None) -> list[tuple[datetime, object]]:
        """(frame, metadata) of the frames that a request returns."""
        return self.store.metadata(start, stop)

    # --- what follows from it ---
    @property
    def period(self) -> tuple[datetime, datetime] | None:
        found = self.all_times
        return (found[0], found[-1]) if found else None

    @property
    def extent(self):
        """(x1, y1, x2, y2) in WGS 84, or None."""
        return self.bounds.transformed("EPSG:4326").bbox if self.bounds else None

    @property
    def geometry(self):
        """The extent as WKT in the raster's projection, or None."""
        if not self.bounds:
            return None
        x1, y1, x2, y2 = self.bounds.bbox
        return f"POLYGON (({x1} {y1}, {x2} {y1}, {x2} {y2}, {x1} {y2}, {x1} {y1}))"

    @property
    def projection(self) -> str | None:
        return self.grid.crs if self.grid else None

    @property
    def geo_transform(self):
        return self.grid.geo_transform if self.grid else None

    @property
    def fillvalue(self):
        return None if self.dtype == "bool" else dtype_max(self.dtype)

    def __len__(self):
        return len(self.all_times)

    def __bool__(self):
        return True

    def get_data(self, spark: SparkSession, mode: str = "vals", bbox=None, width: int | None = None, height: int | None = None, projection: str | None = None, start=None, stop=None) -> DataFrame:
        """vals: (t, i, j, v); time: (t); meta: (t, meta). A bbox without area asks for the cell at a point. No rows if nothing is there."""
        if mode == "time":
            return spark.createDataFrame([(t,) for t in self.times(start, stop)], "t timestamp_ntz")
        if mode == "meta":
            found = self.metadata(start, stop)
            nested = any(isinstance(m, (list, tuple)) for _, m in found)
            kind = "array<string>" if nested else "string"
            return spark.createDataFrame([(t, None if m is None else [*map(str, m)] if nested else str(m)) for t, m in found], f"t timestamp_ntz, meta {kind}")
        if mode != "vals":
            raise ValueError(f"unknown mode {mode!r}")
        grid = self.grid if bbox is None else Grid.from_bbox(bbox, width or 1, height or 1, projection or self.projection)
        if grid is None:
            return spark.createDataFrame([], f"t timestamp_ntz, i int, j int, v {spark_type(self.dtype)}")
        return Context(spark).cells(self, Request(grid, start, stop)).table()

    def get_compute_graph(self, spark: SparkSession, bbox=None, width=None, height=None, projection=None, start=None, stop=None) -> tuple[dict[str, DataFrame], str]:
        """Every planned block of the view by name, each a lazy table of cells, and this one's name. Equal (block, request) pairs are one entry."""
        grid = self.grid if bbox is None else Grid.from_bbox(bbox, width or 1, height or 1, projection or self.projection)
        ctx = Context(spark)
        ctx.cells(self, Request(grid, start, stop))
        names = {key: f"{key[0]}_{k}" for k, key in enumerate(ctx.memo)}
        return {names[key]: cells.table() for key, cells in ctx.memo.items()}, names[self.token, Request(grid, start, stop)]

    def to_file(self, spark: SparkSession, url: str, **request):
        from ..sources.sinks import write_raster

        return write_raster(self, spark, url, **request)

    # --- operators ---
    def _op(name, swap=False):  # noqa: N805
        def method(self, other):
            from ..operators import elemwise

            return getattr(elemwise, name)(other, self) if swap else getattr(elemwise, name)(self, other)

        return method

    __add__, __sub__, __mul__, __truediv__, __pow__ = _op("Add"), _op("Subtract"), _op("Multiply"), _op("Divide"), _op("Power")
    __radd__, __rsub__, __rmul__, __rtruediv__ = _op("Add", True), _op("Subtract", True), _op("Multiply", True), _op("Divide", True)
    __gt__, __ge__, __lt__, __le__ = _op("Greater"), _op("GreaterEqual"), _op("Less"), _op("LessEqual")
    __and__, __or__, __xor__ = _op("And"), _op("Or"), _op("Xor")
    _eq, _ne = _op("Equal"), _op("NotEqual")
    del _op

    def __eq__(self, other):
        return self._eq(other)

    def __ne__(self, other):
        return self._ne(other)

    def __hash__(self):
        return hash(self.token)

    def __neg__(self):
        return self * -1

    def __invert__(self):
        from ..operators.elemwise import Invert

        return Invert(self)


def union_times(blocks) -> list[datetime]:
    return sorted({t for b in blocks for t in b.all_times})


def aligned_step(blocks) -> timedelta | None:
    """The common step of rasters whose frames lie on one regular axis, else None."""
    blocks = [b for b in blocks if b.all_times]
    steps = {b.timedelta for b in blocks}
    if len(steps) != 1 or None in steps:
        return None
    step, first = steps.pop(), blocks[0].all_times[0]
    return step if all((b.all_times[0] - first) % step == timedelta(0) for b in blocks) else None
