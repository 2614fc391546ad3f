"""Outlier flags on streams: statistics of event-time windows, and flags against fixed limits.

Exact quartiles need all rows of a window, which a stream cannot keep; windows use mean and deviation (and approximate
quartiles), and limits for flags come from a table that was summarised before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import need, quoted


def window_statistics(events: DataFrame, time: str, value: str, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """start, end, by, n, mean, std, min, max and approximate quartiles of each window; rows later than `late` behind
    the newest are dropped from closed windows. Works on streams and tables alike."""
    need(events, [time, value, *by])
    x = quoted(value).cast("double")
    events = events.withColumn(time, quoted(time).cast("timestamp"))  # watermarks need a time zone
    grouped = events.withWatermark(time, late).groupBy(F.window(quoted(time), window, slide), *[quoted(c) for c in by])
    stats = grouped.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.approx_percentile(x, F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias("quartiles"))
    return stats.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[quoted(c) for c in by], "n", "mean", "std", "min", "max", "quartiles")


def limits(history: DataFrame, value: str, multiplier: float = 1.5) -> tuple[float, float]:
    """The fences of a table's quartiles."""
    low, high = history.select(F.percentile(quoted(value).cast("double"), F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first().q
    return low - multiplier * (high - low), high + multiplier * (high - low)


def flag(events: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """events with `<value>_iqr_pass`, stateless; missing values pass."""
    x = quoted(value).cast("double")
    return events.withColumn(f"{value}_iqr_pass", ~F.coalesce((x < low) | (x > high), F.lit(False)))
