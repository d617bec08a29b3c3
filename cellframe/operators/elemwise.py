"""Raster algebra, cell by cell. No data in any operand of maths gives no data, as does a result that isn't finite; comparisons with no data are false, and NotEqual true."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.meta import Request, dtype_of_value, is_float, math_dtype, spark_type
from ..plans.raster import Cells, Context, RasterBlock


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


class BaseElementwise(RasterBlock):
    """Rasters that agree in time, cell by cell. Period and extent are intersections."""

    def __init__(self, *args):
        super().__init__(*args)
        rasters = self.rasters
        if not rasters:
            raise TypeError("at least one raster is needed")
        if len({r.temporal for r in rasters}) > 1:
            raise ValueError("temporal and non-temporal rasters don't combine")
        if len({r.timedelta for r in rasters if r.timedelta}) > 1:
            raise ValueError("rasters with different time steps don't combine")

    @property
    def rasters(self) -> list[RasterBlock]:
        return [a for a in self.args if isinstance(a, RasterBlock)]

    @property
    def all_times(self):
        common = set(self.rasters[0].all_times).intersection(*(r.all_times for r in self.rasters))
        return sorted(common)

    @property
    def bounds(self):
        out = self.rasters[0].bounds
        for r in self.rasters[1:]:
            out = out.intersection(r.bounds) if out and r.bounds else None
        return out

    def of(self, *values) -> Column:
        raise NotImplementedError

    def plan(self, ctx: Context, request: Request) -> Cells:
        if len(self.rasters) > 1 and (times := self.times(request.start, request.stop)):
            # the same frames are asked of all
            request = Request(request.grid, times[0], times[-1])
        parts = iter(joined := ctx.join(*(ctx.cells(r, request) for r in self.rasters)))
        values = [next(parts).v if isinstance(a, RasterBlock) else a for a in self.args]
        return Cells(joined[0].df, self.of(*values), joined[0].times, joined[0].source)


def _scalar(x):
    """Numbers of numpy, and arrays with one, as plain numbers."""
    return x.item() if hasattr(x, "item") and getattr(x, "size", 0) == 1 else x


def _number(x) -> None:
    if isinstance(x, bool) or not isinstance(x, (int, float, RasterBlock)):
        raise TypeError(f"a raster or number is needed, not {type(x).__name__}")


class BaseMath(BaseElementwise):
    least_float = False

    def __init__(self, a, b):
        a, b = _scalar(a), _scalar(b)
        _number(a), _number(b)
        super().__init__(a, b)

    @property
    def dtype(self) -> str:
        kinds = [a.dtype if isinstance(a, RasterBlock) else dtype_of_value(a) for a in self.args]
        out = math_dtype(*kinds)
        return str(math_dtype(out, "float32")) if self.least_float else out

    def operands(self, a, b):
        kind = spark_type(self.dtype)
        return (x.cast(kind) if isinstance(x, Column) else F.lit(x).cast(kind) for x in (a, b))

    def of(self, a, b):
        a, b = self.operands(a, b)
        out = self.math(a, b)
        return finite(out) if is_float(self.dtype) else out


class Add(BaseMath):
    def math(self, a, b):
        return F.try_add(a, b)


class Subtract(BaseMath):
    def math(self, a, b):
        return F.try_subtract(a, b)


class Multiply(BaseMath):
    def math(self, a, b):
        return F.try_multiply(a, b)


class Divide(BaseMath):
    """x / 0 is no data."""

    least_float = True

    def math(self, a, b):
        return F.try_divide(a.cast("double"), b.cast("double")).cast(spark_type(self.dtype))


class Power(BaseMath):
    """A negative whole exponent gives a float."""

    @property
    def dtype(self):
        kind = super().dtype
        return math_dtype(kind, "float32") if isinstance(self.args[1], int) and self.args[1] < 0 else kind

    def math(self, a, b):
        out = F.pow(a.cast("double"), b.cast("double"))
        if is_float(self.dtype):
            return out.cast(spark_type(self.dtype))
        return F.expr("NULL").cast(spark_type(self.dtype)) if out is None else F.when(F.abs(out) < 9.2e18, out).try_cast(spark_type(self.dtype))


class BaseComparison(BaseElementwise):
    dtype = property(lambda self: "bool")
    otherwise = False

    def __init__(self, a, b):
        a, b = _scalar(a), _scalar(b)
        _number(a), _number(b)
        super().__init__(a, b)

    def of(self, a, b):
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
        return F.coalesce(self.compare(a, b), F.lit(self.otherwise))


class Equal(BaseComparison):
    def compare(self, a, b):
        return a == b


class NotEqual(BaseComparison):
    otherwise = True

    def compare(self, a, b):
        return a != b


class Greater(BaseComparison):
    def compare(self, a, b):
        return a > b


class GreaterEqual(BaseComparison):
    def compare(self, a, b):
        return a >= b


class Less(BaseComparison):
    def compare(self, a, b):
        return a < b


class LessEqual(BaseComparison):
    def compare(self, a, b):
        return a <= b


class BaseLogic(BaseElementwise):
    dtype = property(lambda self: "bool")

    def __init__(self, a, b):
        for x in (a, b):
            if not (isinstance(x, bool) or (isinstance(x, RasterBlock) and x.dtype == "bool")):
                raise TypeError("logic takes boolean rasters and booleans")
        super().__init__(a, b)

    def of(self, a, b):
        a, b = (F.coalesce(x, F.lit(False)) if isinstance(x, Column) else F.lit(x) for x in (a, b))
        return self.logic(a, b)


class And(BaseLogic):
    def logic(self, a, b):
        return a & b


class Or(BaseLogic):
    def logic(self, a, b):
        return a | b


class Xor(BaseLogic):
    def logic(self, a, b):
        return a != b


class BaseSingle(BaseElementwise):
    def __init__(self, x):
        if not isinstance(x, RasterBlock):
            raise TypeError(f"a raster is needed, not {type(x).__name__}")
        super().__init__(x)


class Invert(BaseSingle):
    dtype = property(lambda self: "bool")

    def __init__(self, x):
        super().__init__(x)
        if x.dtype != "bool":
            raise TypeError("only boolean rasters can be inverted")

    def of(self, x):
        return ~x


class IsData(BaseSingle):
    dtype = property(lambda self: "bool")

    def __init__(self, store):
        super().__init__(store)
        if store.dtype == "bool":
            raise TypeError("boolean rasters have no notion of no data")

    def of(self, x):
        return x.isNotNull()


class IsNoData(IsData):
    def of(self, x):
        return x.isNull()


class FillNoData(BaseElementwise):
    """The rightmost raster that has data."""

    def __init__(self, *rasters):
        if not all(isinstance(r, RasterBlock) for r in rasters):
            raise TypeError("only rasters fill no data")
        super().__init__(*rasters)

    @property
    def dtype(self):
        import numpy as np

        return str(np.result_type(*(r.dtype for r in self.rasters)))

    def of(self, *values):
        return F.coalesce(*(v.cast(spark_type(self.dtype)) for v in reversed(values)))


class BaseLogExp(BaseSingle):
    def __init__(self, x):
        super().__init__(x)
        if x.dtype == "bool":
            raise TypeError("a boolean raster has no logarithm or exponent")

    @property
    def dtype(self):
        return math_dtype(self.args[0].dtype, "float32")

    def of(self, x):
        return finite(self.function(x.cast("double")).cast(spark_type(self.dtype)))


class Exp(BaseLogExp):
    function = staticmethod(F.exp)


class Log(BaseLogExp):
    function = staticmethod(F.ln)


class Log10(BaseLogExp):
    function = staticmethod(F.log10)
