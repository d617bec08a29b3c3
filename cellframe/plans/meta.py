"""Driver-side metadata: grids, extents, types and the choice of frames. Nothing here runs a Spark job."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

import numpy as np

from ..functions import crs as crs_

EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Extent:
    """A box with a projection."""

    bbox: tuple[float, float, float, float]
    crs: str

    def buffered(self, size: float) -> Extent:
        x1, y1, x2, y2 = self.bbox
        return Extent((x1 - size, y1 - size, x2 + size, y2 + size), self.crs)

    def transformed(self, crs: str) -> Extent:
        """The bounds of the transformed corners."""
        if crs_.same(self.crs, crs):
            return self
        x1, y1, x2, y2 = self.bbox
        pts = [crs_.transform_point(x, y, self.crs, crs) for x in (x1, x2) for y in (y1, y2)]
        xs, ys = zip(*pts)
        return Extent((min(xs), min(ys), max(xs), max(ys)), crs)

    def union(self, other: Extent | None) -> Extent:
        if other is None:
            return self
        a, b = self.bbox, other.transformed(self.crs).bbox
        return Extent((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])), self.crs)

    def intersection(self, other: Extent | None) -> Extent | None:
        """None if they share no area."""
        if other is None:
            return None
        a, b = self.bbox, other.transformed(self.crs).bbox
        box = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
        return Extent(box, self.crs) if box[0] < box[2] and box[1] < box[3] else None


@dataclass(frozen=True)
class Grid:
    """Square or oblong cells from a top left corner. A cell owns its top and left edges; rows grow downward."""

    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int
    crs: str

    @classmethod
    def from_bbox(cls, bbox, width: int, height: int, crs: str) -> Grid:
        x1, y1, x2, y2 = map(float, bbox)
        return cls(x1, y2, (x2 - x1) / width, (y2 - y1) / height, int(width), int(height), crs)

    @property
    def is_point(self) -> bool:
        return self.dx == 0 or self.dy == 0

    @property
    def bbox(self):
        return self.x0, self.y0 - self.dy * self.height, self.x0 + self.dx * self.width, self.y0

    @property
    def extent(self) -> Extent:
        return Extent(self.bbox, self.crs)

    @property
    def geo_transform(self):
        return self.x0, self.dx, 0.0, self.y0, 0.0, -self.dy

    def index(self, x: float, y: float) -> tuple[int, int]:
        """(row, column) of the cell that owns a point."""
        return math.floor((self.y0 - y) / self.dy), math.floor((x - self.x0) / self.dx)

    def shifted_from(self, other: Grid) -> tuple[int, int] | None:
        """Rows and columns by which this grid's corner lies inside other, if the two have the same cells."""
        if self.is_point or other.is_point or not crs_.same(self.crs, other.crs) or not (math.isclose(self.dx, other.dx, rel_tol=1e-9) and math.isclose(self.dy, other.dy, rel_tol=1e-9)):
            return None
        i, j = (other.y0 - self.y0) / other.dy, (self.x0 - other.x0) / other.dx
        return (round(i), round(j)) if abs(i - round(i)) < 1e-6 and abs(j - round(j)) < 1e-6 else None

    def widened(self, rows: int, cols: int) -> Grid:
        """With a margin of cells on all sides."""
        return replace(self, x0=self.x0 - cols * self.dx, y0=self.y0 + rows * self.dy, width=self.width + 2 * cols, height=self.height + 2 * rows)


@dataclass(frozen=True)
class Request:
    """What is asked of a block: a window of cells, and frames (see frames_between)."""

    grid: Grid | None = None
    start: datetime | None = None
    stop: datetime | None = None


def frames_between(times: list[datetime], start: datetime | None, stop: datetime | None) -> list[datetime]:
    """No start: the last frame. A start only: the nearest frame, a tie going to the even index. Both: all in the closed interval."""
    if not times:
        return []
    if start is None:
        return [times[-1]]
    if stop is None:
        k = bisect_left(times, start)
        if k == 0 or (k < len(times) and times[k] == start):
            return [times[min(k, len(times) - 1)]]
        if k == len(times):
            return [times[-1]]
        before, after = start - times[k - 1], times[k] - start
        nearer = k - 1 if before < after or (before == after and (k - 1) % 2 == 0) else k
        return [times[nearer]]
    return times[bisect_left(times, start) : bisect_right(times, stop)]


def nearest(times: list[datetime], t: datetime, direction: str = "nearest") -> datetime:
    """The as-of rule: the last at or before, the first at or after, or the nearest frame (a tie to the earlier); clamped to the ends."""
    if direction == "backward":
        return times[max(0, bisect_right(times, t) - 1)]
    k = bisect_left(times, t)
    if direction == "forward":
        return times[min(k, len(times) - 1)]
    if k == 0 or k == len(times):
        return times[min(k, len(times) - 1)]
    return times[k - 1] if t - times[k - 1] <= times[k] - t else times[k]


def regular(first: datetime, delta: timedelta | None, n: int) -> list[datetime]:
    return [first + k * delta for k in range(n)] if delta is not None else [first] * min(n, 1)


def step_of(times: list[datetime]) -> timedelta | None:
    """The step of an equidistant list of two or more."""
    steps = {b - a for a, b in zip(times, times[1:])}
    return steps.pop() if len(steps) == 1 else None


def from_ms(ms: int | float) -> datetime:
    return EPOCH + timedelta(milliseconds=ms)


def to_ms(t: datetime) -> int:
    return round((t - EPOCH) / timedelta(milliseconds=1))


# --- types ---

#: Spark has no unsigned types: the next wider signed one is used.
SPARK_TYPES = {"bool": "boolean", "int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double", "object": "string"}


def spark_type(dtype: str) -> str:
    return SPARK_TYPES[str(np.dtype(dtype))]


def is_float(dtype: str) -> bool:
    return np.dtype(dtype).kind == "f"


def math_dtype(*dtypes: str, least: str = "int32") -> str:
    """At least int32 or float32."""
    found = np.result_type(*dtypes)
    return str(np.result_type(found, "float32" if found.kind == "f" else least))


def dtype_of_value(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int32" if -(2**31) <= value < 2**31 else "int64"
    return "float32" if isinstance(value, float) else str(np.asarray(value).dtype)


def dtype_max(dtype: str):
    """The usual no-data number of a type, for export."""
    kind = np.dtype(dtype)
    return float(np.finfo(kind).max) if kind.kind == "f" else int(np.iinfo(kind).max) if kind.kind in "iu" else None


def parse_percentile(statistic: str) -> float | None:
    """q of 'p<q>' between 0 and 100; None if it's something else."""
    if not (m := re.fullmatch(r"p([\d.]+)", str(statistic))):
        return None
    q = float(m[1])
    if not 0 <= q <= 100:
        raise ValueError(f"percentiles lie between 0 and 100, not {q}")
    return q


def statistic_dtype(dtype: str, statistic: str) -> str:
    if statistic in ("min", "max", "first", "last"):
        return dtype
    if statistic == "product" and not is_float(dtype):
        # outgrows any integer, and is computed in double precision
        return "float64"
    if statistic in ("sum", "product"):
        return math_dtype(dtype)
    if statistic in ("count", "argmin", "argmax"):
        return "int32"
    return "float64" if np.dtype(dtype).itemsize > 4 or np.dtype(dtype) == np.dtype("float64") else "float32"
