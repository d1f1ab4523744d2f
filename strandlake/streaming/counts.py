"""Running counts over streams: an addition to the batch operators, which have no time model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(stream: DataFrame, column: str) -> DataFrame:
    """Running counts per value; complete or update mode."""
    return stream.groupBy(column).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, column: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per time window and value; rows later than ``late`` are dropped and closed windows leave the state."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), column).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), column, "n")


def running_moments(stream: DataFrame, column: str, value: str) -> DataFrame:
    """Mergeable mean, spread and range per key; complete or update mode."""
    return stream.groupBy(column).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
