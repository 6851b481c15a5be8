"""Series range scan, label subset scan, and pruning of files by their time range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_of(ts: int, width_ms: int) -> int:
    """The bucket of an instant, truncated toward zero: the one rule for what files are written by and pruned by."""
    return abs(ts) // width_ms * (1 if ts >= 0 else -1)


def bucket_column(width_ms: int, ts: str = "ts") -> Column:
    """``bucket_of`` as a column."""
    return F.expr(f"`{ts}` div {int(width_ms)}L")


def scan_series(samples: DataFrame, key: str, start: int, end: int, bucket_ms: int | None = None) -> DataFrame:
    """Rows of exactly one series with ``start <= ts <= end``.

    A filter on ``ts`` does not imply one on the partition column, so with ``bucket_ms`` both are given.
    """
    df = samples.where((F.col("series_key") == key) & F.col("ts").between(start, end))
    if bucket_ms and "time_bucket" in samples.columns:
        df = df.where(F.col("time_bucket").between(bucket_of(start, bucket_ms), bucket_of(end, bucket_ms)))
    return df


def scan_labels(samples: DataFrame, metric: str, labels: dict[str, str], start: int, end: int) -> DataFrame:
    """Rows of every series of a metric that has at least the given labels (an extra beside exact selection)."""
    df = samples.where((F.col("metric") == metric) & F.col("ts").between(start, end))
    for k, v in labels.items():
        df = df.where(F.col("labels")[k] == v)
    return df


def overlaps(start: int, end: int, low: str = "min_time", high: str = "max_time") -> Column:
    """Whether a file's inclusive time range meets [start, end]."""
    return (F.col(low) <= end) & (F.col(high) >= start)


def file_stats(samples: DataFrame, file_id: Column | str) -> DataFrame:
    """Per file: min_time, max_time, num_samples."""
    col = F.col(file_id) if isinstance(file_id, str) else file_id
    return samples.groupBy(col.alias("file_id")).agg(
        F.min("ts").alias("min_time"), F.max("ts").alias("max_time"), F.count(F.lit(1)).alias("num_samples")
    )


def list_series(samples: DataFrame) -> DataFrame:
    """Distinct series keys."""
    return samples.select("series_key").distinct()
