"""Statistics that skip NULL, as grouped aggregates and over the columns of one row. Deviations are of the population; percentiles interpolate linearly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.meta import parse_percentile, spark_type, statistic_dtype

REDUCE = ("first", "last", "count", "sum", "mean", "min", "max", "argmin", "argmax", "std", "var", "median", "product")
TEMPORAL = ("sum", "count", "min", "max", "mean", "median", "std", "var")
ZONAL = ("sum", "count", "min", "max", "mean", "median")


def check(statistic: str, allowed=REDUCE) -> str:
    if statistic not in allowed and parse_percentile(statistic) is None:
        raise ValueError(f"unknown statistic {statistic!r}; known: {', '.join(allowed)}, p<q>")
    return statistic


def grouped(statistic: str, v: Column, rank: Column | None = None) -> Column:
    """Of the rows of a group. Sum and count of nothing are 0, the rest NULL. rank orders rows for first, last, argmin and argmax."""
    if (q := parse_percentile(statistic)) is not None:
        return F.percentile(v.cast("double"), F.lit(q / 100))
    d = v.cast("double")
    known = F.when(v.isNotNull(), rank) if rank is not None else None
    return {
        "first": lambda: F.min_by(v, known),
        "last": lambda: F.max_by(v, known),
        "count": lambda: F.count(v).cast("int"),
        "sum": lambda: F.coalesce(F.sum(v), F.lit(0)),
        "mean": lambda: F.avg(d),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "argmin": lambda: F.min_by(rank, F.when(v.isNotNull(), F.struct(v, rank))),
        "argmax": lambda: F.max_by(rank, F.when(v.isNotNull(), F.struct(v, -rank))),
        "std": lambda: F.stddev_pop(d),
        "var": lambda: F.var_pop(d),
        "median": lambda: F.median(d),
        "product": lambda: F.product(d),
    }[statistic]()


def across(statistic: str, values: list[Column], dtype: str) -> Column:
    """Of values side by side in one row."""
    kind, out = spark_type(dtype), spark_type(statistic_dtype(dtype, statistic))
    values = [v.cast(kind) for v in values]
    there = F.filter(F.array(*values), lambda x: x.isNotNull())
    n = F.size(there)
    total = F.aggregate(there, F.lit(0.0), lambda s, x: s + x.cast("double"))
    mean = F.try_divide(total, n)
    if statistic == "median" or parse_percentile(statistic) is not None:
        at = (n - 1) * ((parse_percentile(statistic) or 50.0) / 100 if statistic != "median" else 0.5)
        ordered = F.array_sort(there)
        low = F.get(ordered, F.floor(at).cast("int")).cast("double")
        high = F.get(ordered, F.ceil(at).cast("int")).cast("double")
        return F.when(n > 0, low + (high - low) * (at - F.floor(at))).cast(out)
    if statistic in ("argmin", "argmax"):
        pick = F.array_min(there) if statistic == "argmin" else F.array_max(there)
        return F.when(n > 0, F.array_position(F.array(*values), pick) - 1).cast(out)
    return {
        "first": lambda: F.coalesce(*values),
        "last": lambda: F.coalesce(*reversed(values)),
        "count": lambda: n,
        "sum": lambda: F.aggregate(there, F.lit(0).cast(out), lambda s, x: (s + x.cast(out)).cast(out)),
        "mean": lambda: mean,
        "min": lambda: F.array_min(there),
        "max": lambda: F.array_max(there),
        "std": lambda: F.sqrt(_variance(there, mean, n)),
        "var": lambda: _variance(there, mean, n),
        "product": lambda: F.when(n > 0, F.aggregate(there, F.lit(1.0), lambda s, x: s * x.cast("double"))),
    }[statistic]().cast(out)


def _variance(there, mean, n):
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + (x.cast("double") - mean) * (x.cast("double") - mean)), n)
