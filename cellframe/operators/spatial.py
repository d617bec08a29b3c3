"""Stencils and placement. A stencil reads its window with a margin, so that edges are exact, and drops the margin afterwards.

Neighbours in a row or column come from window functions over that row or column of one frame: a partition is never larger than the width or
height of the window asked for, and no cell is copied once for every neighbour.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import crs as crs_
from ..functions import statistics
from ..plans.meta import Extent, Grid, Request, spark_type, statistic_dtype
from ..plans.raster import KEY, Cells, Context
from .temporal import _Single


def row():
    return Window.partitionBy("t", "i").orderBy("j")


def column():
    return Window.partitionBy("t", "j").orderBy("i")


class _Stencil(_Single):
    def margins(self, grid: Grid) -> tuple[int, int]:
        """Rows and columns of margin."""
        return 1, 1

    def over(self, df, grid: Grid):
        """(t, i, j, v) -> the same, with results in v."""
        raise NotImplementedError

    def plan(self, ctx: Context, request: Request) -> Cells:
        grid = request.grid
        rows, cols = self.margins(grid)
        cells = ctx.cells(self.args[0], Request(grid.widened(rows, cols), request.start, request.stop))
        df = self.over(cells.table(), grid)
        df = df.filter(F.col("i").between(rows, rows + grid.height - 1) & F.col("j").between(cols, cols + grid.width - 1))
        return ctx.leaf(df.select("t", (F.col("i") - rows).alias("i"), (F.col("j") - cols).alias("j"), F.col("v").cast(spark_type(self.dtype)).alias("v")), cells.times)


class Dilate(_Stencil):
    """Each listed value, in order, spreads to the four neighbours of the cells that have it; later ones overwrite."""

    def __init__(self, store, values):
        super().__init__(store, [*values])

    def over(self, df, grid):
        df = df.select("*", F.lag("v").over(row()).alias("l"), F.lead("v").over(row()).alias("r"))
        df = df.select("*", F.lag("v").over(column()).alias("u"), F.lead("v").over(column()).alias("d"))
        out = F.col("v")
        for value in self.args[1]:
            hit = F.lit(False)
            for c in ("v", "l", "r", "u", "d"):
                hit = hit | F.coalesce(F.col(c) == F.lit(value), F.lit(False))
            out = F.when(hit, F.lit(value).cast(spark_type(self.dtype))).otherwise(out)
        return df.withColumn("v", out)


class MovingMax(_Stencil):
    """The greatest value in a circle around each cell, no data left out. The size in cells is made odd, 3 at least."""

    def __init__(self, store, size):
        size = int(round(size))
        size = max(3, size + (size % 2 == 0))
        super().__init__(store, size)

    def margins(self, grid):
        return self.args[1] // 2, self.args[1] // 2

    def over(self, df, grid):
        r, reach = self.args[1] // 2, self.args[1] ** 2 / 4
        # half the width of the circle in the row that is di away
        half = {di: max(dj for dj in range(r + 1) if di * di + dj * dj < reach) for di in range(-r, r + 1) if di * di < reach}
        wide = df.select("*", *(F.max("v").over(row().rowsBetween(-w, w)).alias(f"w{w}") for w in sorted(set(half.values()))))
        # a row's maximum of each width, then over the rows that use it: the outermost with that width bound the middle ones
        parts = []
        for w in sorted(set(half.values())):
            at = sorted(di for di in half if half[di] == w)
            low = [di for di in at if di <= 0]
            high = [di for di in at if di >= 0]
            for run in {(min(low), max(low)) if low else None, (min(high), max(high)) if high else None} - {None}:
                parts.append(F.max(f"w{w}").over(column().rowsBetween(*run)))
        out = parts[0] if len(parts) == 1 else F.greatest(*parts)
        return wide.withColumn("v", out)


class Smooth(_Stencil):
    """A Gaussian of sigma size / 3 (metres), no data counting as `fill`. The result has no no data."""

    def __init__(self, store, size, fill=0):
        super().__init__(store, float(size), fill)

    def _sizes(self, grid):
        """Size in rows and columns."""
        if crs_.is_geographic(grid.crs):
            x1, y1, x2, y2 = Extent(grid.bbox, grid.crs).transformed("EPSG:3857").bbox
            return self.args[1] * grid.height / (y2 - y1), self.args[1] * grid.width / (x2 - x1)
        return self.args[1] / grid.dy, self.args[1] / grid.dx

    def margins(self, grid):
        return tuple(int(4 * s / 3 + 0.5) for s in self._sizes(grid))

    def over(self, df, grid):
        rows, cols = self._sizes(grid)
        fill = F.lit(self.args[2]).cast("double")
        inside = round(rows), round(cols)
        margin = self.margins(grid)
        # beyond three sigma cells count as fill
        near = F.col("i").between(margin[0] - inside[0], margin[0] + grid.height - 1 + inside[0]) & F.col("j").between(margin[1] - inside[1], margin[1] + grid.width - 1 + inside[1])
        df = df.withColumn("v", F.when(near, F.coalesce(F.col("v").cast("double"), fill)).otherwise(fill))
        for size, r, window in ((cols, margin[1], row()), (rows, margin[0], column())):
            if r == 0:
                continue
            sigma = size / 3
            weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
            kernel = F.array(*(F.lit(w / sum(weights)) for w in weights))
            found = F.collect_list("v").over(window.rowsBetween(-r, r))
            total = F.aggregate(F.zip_with(found, kernel, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
            df = df.withColumn("v", total)
        return df


class HillShade(_Stencil):
    """Shading of heights, 0 to 255, from 3x3 gradients."""

    def __init__(self, store, altitude=45, azimuth=315, fill=0):
        super().__init__(store, float(altitude), float(azimuth), fill)

    dtype = property(lambda self: "uint8")
    fillvalue = property(lambda self: 256)

    def over(self, df, grid):
        _, altitude, azimuth, fill = self.args
        df = df.withColumn("v", F.coalesce(F.col("v").cast("double"), F.lit(fill).cast("double")))
        # Horn's gradients: three cells on either side, the one in the middle twice
        beside = df.select("*", F.lag("v").over(row()).alias("west"), F.lead("v").over(row()).alias("east"))
        columns = beside.select("*", (F.col("west") + 2 * F.col("v") + F.col("east")).alias("across"))
        for side in ("west", "east"):
            columns = columns.withColumn(f"along_{side}", F.lag(side).over(column()) + 2 * F.col(side) + F.lead(side).over(column()))
        around = columns.select("*", F.lag("across").over(column()).alias("north"), F.lead("across").over(column()).alias("south"))
        single = lambda c: c.cast("float").cast("double")
        y = single((F.col("north") - F.col("south")) / grid.dy)
        x = single((F.col("along_west") - F.col("along_east")) / grid.dx)
        alt, az, k = math.radians(altitude), math.radians(azimuth), 1 / 8
        slope = x * x + y * y
        c = (math.sin(alt) - math.cos(alt) * k * F.sqrt(slope) * F.sin(F.atan2(y, x) - az)) / F.sqrt(1 + k * k * slope)
        return around.withColumn("v", F.when(c <= 0, 0).otherwise(F.floor(255 * c)))


class Place(_Single):
    """The raster stamped with its anchor at each coordinate; where stamps overlap, a statistic of them in the order of coordinates."""

    def __init__(self, store, place_projection, anchor, coordinates, statistic="last"):
        statistics.check(statistic)
        coordinates = [[float(x), float(y)] for x, y in coordinates]
        if len(anchor) != 2:
            raise ValueError("an anchor is a point")
        super().__init__(store, crs_.normalise(place_projection), [*map(float, anchor)], coordinates, statistic)

    dtype = property(lambda self: statistic_dtype(self.args[0].dtype, self.args[4]))

    @property
    def bounds(self):
        store, crs, (ax, ay), coordinates, _ = self.args
        if not store.bounds or not coordinates:
            return None
        x1, y1, x2, y2 = store.bounds.transformed(crs).bbox
        xs, ys = zip(*coordinates)
        return Extent((min(xs) + x1 - ax, min(ys) + y1 - ay, max(xs) + x2 - ax, max(ys) + y2 - ay), crs)

    def plan(self, ctx, request):
        store, crs, (ax, ay), coordinates, statistic = self.args
        grid, times = request.grid, self.times(request.start, request.stop)
        if not times or not store.bounds:
            return self.empty(ctx)
        if not crs_.same(grid.crs, crs):
            raise NotImplementedError("Place answers in its own projection")
        x1, y1, x2, y2 = store.bounds.transformed(crs).bbox
        stamp = Grid(x1, y2, grid.dx, grid.dy, max(1, math.ceil((x2 - x1) / grid.dx - 1e-9)), max(1, math.ceil((y2 - y1) / grid.dy - 1e-9)), crs)
        moves = []
        for rank, (x, y) in enumerate(coordinates):
            di, dj = round((grid.y0 - y) / grid.dy - (y2 - ay) / grid.dy), round((x - grid.x0) / grid.dx - (ax - x1) / grid.dx)
            if -stamp.height < di < grid.height and -stamp.width < dj < grid.width:
                moves.append((rank, di, dj))
        kind = spark_type(self.dtype)
        blank = ctx.frames([(t,) for t in times], ["t"]).crossJoin(ctx.window(grid))
        if not moves:
            zero = F.lit(0 if statistic in ("sum", "count") else None).cast(kind)
            return ctx.leaf(blank.withColumn("v", zero), times)
        cells = ctx.cells(store, Request(stamp, request.start, request.stop))
        # moves are arguments of the block, so their table has a bound that is known here
        moved = cells.table().filter("v is not null").join(F.broadcast(ctx.spark.createDataFrame(moves, "rank int, di int, dj int")))
        moved = moved.select("t", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "v", "rank")
        moved = moved.filter(F.col("i").between(0, grid.height - 1) & F.col("j").between(0, grid.width - 1))
        source = spark_type(store.dtype)
        rows = moved.unionByName(blank.select(*KEY, F.lit(None).cast(source).alias("v"), F.lit(None).cast("int").alias("rank")))
        return ctx.leaf(rows.groupBy(*KEY).agg(statistics.grouped(statistic, F.col("v"), F.col("rank")).cast(kind).alias("v")), times)


class RasterTiler(_Single):
    """A physical hint: cells of a tile come to one partition. The result is the same."""

    def __init__(self, source, tile_size):
        h, w = (tile_size, tile_size) if isinstance(tile_size, int) else tile_size
        if min(h, w) < 1:
            raise ValueError("tiles have at least one cell")
        super().__init__(source, [int(h), int(w)])

    def plan(self, ctx, request):
        h, w = self.args[1]
        cells = ctx.cells(self.args[0], request)
        df = cells.table().repartition(F.floor(F.col("i") / h), F.floor(F.col("j") / w))
        return ctx.leaf(df, cells.times)
