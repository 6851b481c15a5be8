"""Downsampling and range aggregation, for all series at once.

Every function is algebraic (or ``max_by``), so Spark combines on the map side and only partial states shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def function_of(name: str) -> Column:
    """The aggregate of a function name. RATE has no bucket form and means LAST there."""
    v = F.col("value")
    match name.upper():
        case "AVG":
            return F.avg(v)
        case "SUM":
            return F.sum(v)
        case "MIN":
            return F.min(v)
        case "MAX":
            return F.max(v)
        case "COUNT":
            return F.count(v).cast("double")
        case "LAST" | "RATE":
            return F.max_by(v, F.col("ts"))
    raise ValueError(f"unknown function {name!r}")


def downsample(df: DataFrame, interval_ms: int, function: str = "AVG") -> DataFrame:
    """One row per series and non-empty bucket, stamped with the bucket's start.

    Buckets are aligned to the epoch and truncate toward zero; an interval <= 0 returns the input.
    """
    if interval_ms <= 0:
        return df.select("series_key", "ts", "value")
    bucket = F.expr(f"(ts div {int(interval_ms)}L) * {int(interval_ms)}L")
    # grouping by a new name: an alias "ts" would shadow the ts that LAST needs
    return (
        df.groupBy("series_key", bucket.alias("bucket_ts"))
        .agg(function_of(function).alias("value"))
        .select("series_key", F.col("bucket_ts").alias("ts"), "value")
    )


def aggregate(df: DataFrame, function: str) -> DataFrame:
    """One row per series, stamped with its last timestamp; no row for an empty input."""
    return (
        df.groupBy("series_key")
        .agg(F.max("ts").alias("last_ts"), function_of(function).alias("value"))
        .select("series_key", F.col("last_ts").alias("ts"), "value")
    )
