"""Tumbling windows over a stream of cells: the streaming form of TemporalAggregate for fixed frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frequency as freq
from ..functions import statistics

#: Statistics whose state is bounded, so a stream can keep them.
BOUNDED = ("sum", "count", "min", "max", "mean", "std", "var")


def aggregate_stream(cells: DataFrame, frequency: str, statistic: str = "sum", lateness: str = "1 day") -> DataFrame:
    """(t, i, j, v) as a stream -> (t, i, j, v) by window; rows later than `lateness` behind the newest are dropped, as the watermark says. t is cast to a timestamp, labels are window starts."""
    if statistic not in BOUNDED:
        raise ValueError(f"a stream can't keep {statistic!r}; known: {', '.join(BOUNDED)}")
    step = freq.step(frequency)
    if step is None:
        raise ValueError(f"{frequency!r} is not a fixed frequency")
    width = f"{int(step.total_seconds())} seconds"
    rows = cells.withColumn("t", F.col("t").cast("timestamp")).withWatermark("t", lateness)
    out = rows.groupBy(F.window("t", width).alias("w"), "i", "j").agg(statistics.grouped(statistic, F.col("v")).alias("v"))
    return out.select(F.col("w.start").alias("t"), "i", "j", "v")
