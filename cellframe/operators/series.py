"""Expressions over feature properties. NULL and NaN compare as false (not-equal as true); x / 0 is infinite, 0 / 0 is NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.block import Block
from ..plans.geometry import FeatureContext, FeatureRequest, GeometryBlock, Series

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def known(c: Column) -> Column:
    """NaN as NULL, for doubles."""
    return F.when(~F.isnan(c.cast("double")), c)


class SeriesBlock(Block):
    kind = "series"

    def series(self, ctx: FeatureContext, request: FeatureRequest) -> Series:
        parts = aligned(ctx, request, *self.args)
        at = next(p for p in parts if isinstance(p, Series))
        return Series(at.df, self.of(*(p.col if isinstance(p, Series) else p for p in parts)), at.source)

    def of(self, *values) -> Column:
        raise NotImplementedError

    def get_data(self, spark, **request):
        """(fid, value)."""
        from ..functions import crs as crs_

        request = dict(request)
        request["filters"] = tuple((request.get("filters") or {}).items())
        request["projection"] = crs_.normalise(request.get("projection") or self.source.projection)
        found = self.series(FeatureContext(spark), FeatureRequest(**request))
        return found.df.select("fid", found.col.alias("value"))

    @property
    def source(self) -> GeometryBlock:
        for a in self.args:
            if isinstance(a, GeometryBlock):
                return a
            if isinstance(a, SeriesBlock):
                return a.source
        raise TypeError("a series stands on features")

    def _op(name):  # noqa: N805
        return lambda self, other: globals()[name](self, other)

    __add__, __sub__, __mul__, __truediv__ = _op("Add"), _op("Subtract"), _op("Multiply"), _op("Divide")
    __floordiv__, __pow__, __mod__ = _op("FloorDivide"), _op("Power"), _op("Modulo")
    __eq__, __ne__, __gt__, __ge__, __lt__, __le__ = _op("Equal"), _op("NotEqual"), _op("Greater"), _op("GreaterEqual"), _op("Less"), _op("LessEqual")
    __and__, __or__, __xor__ = _op("And"), _op("Or"), _op("Xor")
    del _op

    def __invert__(self):
        return Invert(self)

    def __hash__(self):
        return hash(self.token)


def aligned(ctx: FeatureContext, request: FeatureRequest, *args) -> list:
    """Series of the arguments over one table; constants stay. Tables of different sources are joined on fid."""
    found = [ctx.series(a, request) if isinstance(a, SeriesBlock) else a for a in args]
    series = [s for s in found if isinstance(s, Series)]
    if len({s.source for s in series}) <= 1:
        return found
    df, source, at = None, "+".join(sorted({s.source for s in series})), {}
    for k, s in enumerate(found):
        if isinstance(s, Series):
            part = s.df.select("fid", s.col.alias(f"_s{k}"))
            df = part if df is None else df.join(part, "fid")
            at[k] = F.col(f"_s{k}")
    return [Series(df, at[k], source) if k in at else s for k, s in enumerate(found)]


class GetSeriesBlock(SeriesBlock):
    def __init__(self, source: GeometryBlock, name: str):
        if not isinstance(source, GeometryBlock):
            raise TypeError("a column is taken of features")
        if name not in source.columns:
            raise KeyError(f"column {name!r} isn't there; known: {sorted(source.columns)}")
        super().__init__(source, name)

    def series(self, ctx, request):
        return Series(ctx.features(self.args[0], request), F.col(f"`{self.args[1]}`"), self.args[0].token)


class SetSeriesBlock(GeometryBlock):
    """Features with columns added or replaced: name, series or constant, and so on."""

    def __init__(self, source: GeometryBlock, *pairs):
        if not isinstance(source, GeometryBlock):
            raise TypeError("columns are set on features")
        if not pairs or len(pairs) % 2:
            raise ValueError("names and values come in pairs")
        for name, value in zip(pairs[::2], pairs[1::2]):
            if not isinstance(name, str) or isinstance(value, GeometryBlock):
                raise TypeError("a name and a series or constant are needed")
        super().__init__(source, *pairs)

    columns = property(lambda self: self.args[0].columns | set(self.args[1::2]))

    def plan(self, ctx, request):
        source, pairs = self.args[0], self.args[1:]
        df = ctx.features(source, request)
        fresh, joined = {}, df
        for k, (name, value) in enumerate(zip(pairs[::2], pairs[1::2])):
            if isinstance(value, SeriesBlock):
                s = ctx.series(value, request)
                if s.source == source.token:
                    fresh[name] = s.col
                else:
                    joined = joined.join(s.df.select("fid", s.col.alias(f"_set{k}")), "fid", "left")
                    fresh[name] = F.col(f"_set{k}")
            else:
                fresh[name] = F.lit(value)
        out = joined.withColumns(fresh)
        return out.select(*df.columns, *(n for n in fresh if n not in df.columns))


class _Binary(SeriesBlock):
    def __init__(self, source, other):
        if not isinstance(source, SeriesBlock):
            raise TypeError("a series is needed")
        if not isinstance(other, (SeriesBlock, int, float, bool)):
            raise TypeError(f"a series or number is needed, not {type(other).__name__}")
        super().__init__(source, other)

    def of(self, a, b):
        return self.math(a, b if isinstance(b, Column) else F.lit(b))


class Add(_Binary):
    def math(self, a, b):
        return F.try_add(a, b)


class Subtract(_Binary):
    def math(self, a, b):
        return F.try_subtract(a, b)


class Multiply(_Binary):
    def math(self, a, b):
        return F.try_multiply(a, b)


def _divided(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, known(F.signum(a) * math.inf)).otherwise(F.try_divide(a, b))


class Divide(_Binary):
    def math(self, a, b):
        return _divided(a, b)


class FloorDivide(_Binary):
    def math(self, a, b):
        q = _divided(a, b)
        return F.when(F.abs(q) == math.inf, q).otherwise(F.floor(q).cast("double"))


class Modulo(_Binary):
    """With the sign of the divisor."""

    def math(self, a, b):
        a, b = a.cast("double"), b.cast("double")
        return F.when(b != 0, a - b * F.floor(F.try_divide(a, b)))


class Power(SeriesBlock):
    def __init__(self, source, other):
        if not isinstance(source, SeriesBlock) or isinstance(other, bool) or not isinstance(other, (int, float)):
            raise TypeError("a series and a number are needed")
        super().__init__(source, other)

    def of(self, a, b):
        return F.pow(a.cast("double"), F.lit(float(b)))


class _Comparison(_Binary):
    otherwise = False

    def of(self, a, b):
        a, b = known_if_number(a), known_if_number(b) if isinstance(b, Column) else F.lit(b)
        return F.coalesce(self.compare(a, b), F.lit(self.otherwise))


def known_if_number(c: Column) -> Column:
    return F.when(~F.coalesce(F.isnan(c.try_cast("double")), F.lit(False)), c)


class Equal(_Comparison):
    def compare(self, a, b):
        return a == b


class NotEqual(_Comparison):
    otherwise = True

    def compare(self, a, b):
        return a != b


class Greater(_Comparison):
    def compare(self, a, b):
        return a > b


class GreaterEqual(_Comparison):
    def compare(self, a, b):
        return a >= b


class Less(_Comparison):
    def compare(self, a, b):
        return a < b


class LessEqual(_Comparison):
    def compare(self, a, b):
        return a <= b


class _Logic(SeriesBlock):
    def __init__(self, source, other):
        if not isinstance(source, SeriesBlock) or not isinstance(other, SeriesBlock):
            raise TypeError("logic takes two series")
        super().__init__(source, other)


class And(_Logic):
    def of(self, a, b):
        return a & b


class Or(_Logic):
    def of(self, a, b):
        return a | b


class Xor(_Logic):
    def of(self, a, b):
        return a != b


class Invert(SeriesBlock):
    def __init__(self, source):
        if not isinstance(source, SeriesBlock):
            raise TypeError("a series is needed")
        super().__init__(source)

    def of(self, a):
        return ~a


class Where(SeriesBlock):
    """source where cond holds (a condition that isn't boolean holds where it isn't null), else other."""

    negate = False

    def __init__(self, source, cond, other):
        if not isinstance(source, SeriesBlock) or not isinstance(cond, SeriesBlock):
            raise TypeError("a series and a condition are needed")
        super().__init__(source, cond, other)

    def series(self, ctx, request):
        parts = aligned(ctx, request, *self.args)
        source, cond, other = parts
        held = cond.df.select(cond.col.alias("c")).schema["c"].dataType.simpleString() == "boolean"
        test = F.coalesce(cond.col, F.lit(False)) if held else cond.col.isNotNull()
        other = other.col if isinstance(other, Series) else F.lit(other)
        return Series(source.df, F.when(~test if self.negate else test, source.col).otherwise(other), source.source)


class Mask(Where):
    """The reverse of Where."""

    negate = True


class Round(SeriesBlock):
    """Half to even."""

    def __init__(self, source, decimals=0):
        if not isinstance(source, SeriesBlock):
            raise TypeError("a series is needed")
        super().__init__(source, int(decimals))

    def of(self, a, decimals):
        return F.bround(a, decimals)


class Interp(SeriesBlock):
    """Piecewise linear between points; outside the end values, or left and right."""

    def __init__(self, source, xp, fp, left=None, right=None):
        xp, fp = [*map(float, xp)], [*map(float, fp)]
        if len(xp) != len(fp) or not xp or any(b <= a for a, b in zip(xp, xp[1:])):
            raise ValueError("points must be as many as values, and increase")
        super().__init__(source, xp, fp, left, right)

    def of(self, a, xp, fp, left, right):
        a = known(a.cast("double"))
        out = F.when(a < xp[0], float(fp[0] if left is None else left)).when(a > xp[-1], float(fp[-1] if right is None else right)).when(a == xp[-1], fp[-1])
        for x0, x1, f0, f1 in zip(xp, xp[1:], fp, fp[1:]):
            out = out.when(a < x1, F.lit(f0) + (a - x0) * ((f1 - f0) / (x1 - x0)))
        return out


class Choose(SeriesBlock):
    """The choice with the number that the source holds, from 0; NULL beyond."""

    def __init__(self, source, *choices):
        if len(choices) < 2:
            raise ValueError("at least two choices are needed")
        super().__init__(source, *choices)

    def of(self, a, *choices):
        out = F.when(F.lit(False), choices[0] if isinstance(choices[0], Column) else F.lit(choices[0]))
        for k, c in enumerate(choices):
            out = out.when(a == k, c if isinstance(c, Column) else F.lit(c))
        return out


def _labels(labels):
    if len({*map(str, labels)}) != len(labels):
        raise ValueError("labels must differ")
    return [float(x) for x in labels] if all(isinstance(x, (int, float)) for x in labels) else [*labels]


class Classify(SeriesBlock):
    """Labels by bins: as many as bins less one (NULL outside), or one more (open at both ends)."""

    def __init__(self, source, bins, labels, right=True):
        if len(labels) not in (len(bins) - 1, len(bins) + 1):
            raise ValueError("there must be one label less than bins, or one more")
        if any(b <= a for a, b in zip(bins, bins[1:])):
            raise ValueError("bins must increase")
        super().__init__(source, [*bins], _labels(labels), bool(right))

    def of(self, a, bins, labels, right):
        a = known(a)
        k = F.lit(0)
        for b in bins:
            k = k + ((a > b) if right else (a >= b)).cast("int")
        if len(labels) < len(bins):
            k = k - 1
        return F.when(a.isNotNull() & (k >= 0), F.get(F.array(*map(F.lit, labels)), k))


class ClassifyFromColumns(SeriesBlock):
    """Labels by bins that each feature has in columns of its own; one label more than columns."""

    def __init__(self, source, value_column, bin_columns, labels, right=True):
        if len(labels) != len(bin_columns) + 1:
            raise ValueError("there must be one label more than columns")
        missing = {value_column, *bin_columns} - source.columns
        if missing:
            raise KeyError(f"columns {sorted(missing)} aren't there")
        super().__init__(source, value_column, [*bin_columns], _labels(labels), bool(right))

    def series(self, ctx, request):
        source, value, columns, labels, right = self.args
        a = known(F.col(f"`{value}`"))
        k = F.lit(0)
        for c in columns:
            b = F.col(f"`{c}`")
            k = k + F.coalesce(((a > b) if right else (a >= b)).cast("int"), F.lit(0))
        return Series(ctx.features(source, request), F.when(a.isNotNull(), F.get(F.array(*map(F.lit, labels)), k)), source.token)
