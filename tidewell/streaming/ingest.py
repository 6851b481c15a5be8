"""Streaming ingest of write requests into the sample store, and of change feeds into a change table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.api import flatten_json
from tidewell.operators.changes import feed_rows
from tidewell.sources.changetable import ChangeTable
from tidewell.sources.store import SampleStore


def ingest_requests(bodies: DataFrame, store: SampleStore, checkpoint: str, name: str = "ingest", **trigger) -> StreamingQuery:
    """Write a stream of JSON request bodies (column ``value``); one commit per micro-batch, idempotent by its id."""

    def put(batch: DataFrame, batch_id: int) -> None:
        now = F.unix_millis(F.current_timestamp())
        store.write(flatten_json(batch, "value", now), f"{name}-{batch_id}")

    return bodies.select(F.col("value").cast("string").alias("value")).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def apply_changes(feed: DataFrame, table: ChangeTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply a stream of changes, one commit per micro-batch. A batch replayed after a failure changes nothing, because
    repeated changes lose to equal ones already applied."""
    return feed_rows(feed).writeStream.foreachBatch(lambda batch, _: table.apply(batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
