"""Applying a change feed of samples: inserts, updates and deletes, repeated and out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.model import series_key
from tidewell.runtime import scratch_path
from tidewell.sources.changetable import ChangeTable

ROWS_PER_BUCKET = 250_000


def feed_rows(feed: DataFrame) -> DataFrame:
    """The feed's columns that the state needs, with the canonical series key."""
    return feed.select(series_key().alias("series_key"), "ts", "value", "txn_id", "seq", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"))


def open_table(feed: DataFrame, path: str | None = None, buckets: int | None = None) -> ChangeTable:
    """A table for the feed's state in the shared folder; buckets sized by the feed's row count unless given."""
    spark = feed.sparkSession
    if buckets is None:
        buckets = min(16_384, max(8, -(-feed.count() // ROWS_PER_BUCKET)))
    return ChangeTable(spark, path or scratch_path(spark, "changes"), ["series_key", "ts"], ["txn_id", "seq"], buckets)


def current_state(feed: DataFrame, batches: int = 2, path: str | None = None) -> DataFrame:
    """Current rows (series_key, ts, value, txn_id, seq, is_deleted = false) after the whole feed.

    The feed is applied in ``batches`` commits of equal ranges of ``feed_pos`` (its order of delivery); the result is the
    same for any number and order. The newest change of a key is that of the greatest (txn_id, seq), NULLs lowest;
    keys whose newest change is a delete do not appear. An empty feed gives an empty table.
    """
    table = open_table(feed, path)
    low, high = feed.agg(F.min("feed_pos"), F.max("feed_pos")).first()
    if low is None:
        return feed_rows(feed).limit(0)
    width = -(-(high - low + 1) // batches)
    for i in range(batches):
        part = feed.where(F.col("feed_pos").between(low + i * width, low + (i + 1) * width - 1) | (F.col("feed_pos").isNull() if i == 0 else F.lit(False)))
        table.apply(feed_rows(part))
    return table.read()
