"""Consistent-hash placement of time windows, as DataFrame functions.

The ring (nodes x virtual nodes, some hundred numbers) is part of the task that looks owners up; nothing is joined with it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.resolve import newest
from tidewell.operators.scan import bucket_of
from tidewell.runtime import join_small

#: Virtual nodes of a node, and the width of a placement window (6 hours).
VIRTUAL_NODES = 128
WINDOW_MS = 21_600_000


def ring(spark: SparkSession, nodes: list[str]) -> DataFrame:
    """(hash, node_id): every node at the CRC-32 of ``node-i`` for each virtual node i."""
    ids = spark.createDataFrame([(n,) for n in dict.fromkeys(nodes)], "node_id string")
    v = F.explode(F.sequence(F.lit(0), F.lit(VIRTUAL_NODES - 1))).alias("v")
    return ids.select("node_id", v).select(F.crc32(F.concat_ws("-", "node_id", "v")).alias("hash"), "node_id")


def owners_of(key: str, nodes: list[str], copies: int) -> list[str]:
    """The owners of one key in clockwise order, on the driver."""
    points = sorted((crc32(f"{n}-{i}".encode()), n) for n in dict.fromkeys(nodes) for i in range(VIRTUAL_NODES))
    at = crc32(key.encode())
    turn = [n for h, n in points if h >= at] + [n for h, n in points if h < at]
    return list(dict.fromkeys(turn))[:copies]


def with_owners(keys: DataFrame, nodes: list[str], replicas: int = 2) -> DataFrame:
    """Add ``owners`` (array, clockwise) to rows with a ``partition_key``; give it distinct keys.

    Every batch of keys is looked up in the sorted ring (a few hundred numbers, part of the task), so there is no
    join, no shuffle and no pair of rows. ``replicas <= 0`` means 2; each key has ``replicas + 1`` owners, or all nodes
    if there are fewer. A NULL key has NULL owners.
    """
    copies = (replicas if replicas > 0 else 2) + 1
    points = sorted((crc32(f"{n}-{i}".encode()), n) for n in dict.fromkeys(nodes) for i in range(VIRTUAL_NODES))
    hashes, names = [h for h, _ in points], [n for _, n in points]
    everyone = len(set(names))

    def walk(key: str | None) -> list[str] | None:
        if key is None:
            return None
        at, found = bisect_left(hashes, crc32(key.encode())), {}
        for i in range(len(names)):
            found.setdefault(names[(at + i) % len(names)])
            if len(found) == min(copies, everyone):
                break
        return list(found)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners = [walk(k) for k in b.column(b.schema.get_field_index("partition_key")).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(owners, pa.list_(pa.string()))], names=[*b.schema.names, "owners"])

    return keys.mapInArrow(go, T.StructType([*keys.schema.fields, T.StructField("owners", T.ArrayType(T.StringType()))]))


def partition_for_time(df: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Add partition_key, start_time and end_time (inclusive) of the window that holds ``ts``."""
    i = F.expr(f"ts div {window_ms}L")
    return (
        df.withColumn("partition_key", F.concat(F.lit("partition-"), i.cast("string")))
        .withColumn("start_time", i * window_ms)
        .withColumn("end_time", i * window_ms + (window_ms - 1))
    )


def write_targets(df: DataFrame, nodes: list[str], replicas: int = 2, window_ms: int = WINDOW_MS) -> DataFrame:
    """Every row of ``df`` with its window and owners; owners are worked out once per window."""
    placed = partition_for_time(df, window_ms)
    windows = with_owners(placed.select("partition_key").distinct(), nodes, replicas)
    return join_small(placed, windows, "partition_key")


def query_targets(spark: SparkSession, start: int, end: int, nodes: list[str], replicas: int = 2, window_ms: int = WINDOW_MS) -> DataFrame:
    """Distinct nodes that own any window of [start, end]."""
    first, last = bucket_of(start, window_ms), bucket_of(end, window_ms)
    keys = spark.range(first, last + 1).select(F.concat(F.lit("partition-"), F.col("id").cast("string")).alias("partition_key"))
    return with_owners(keys, nodes, replicas).select(F.explode("owners").alias("node_id")).distinct()


def is_local(node: str, owners: str = "owners"):
    """Whether a node is among the owners."""
    return F.array_contains(owners, node)


def node_info(spark: SparkSession, nodes: dict[str, tuple[str, str]]) -> DataFrame:
    """(node_id, address, status, n_points): the node table with each node's points on the ring; nodes are id -> (address, status)."""
    listed = spark.createDataFrame([(n, *v) for n, v in nodes.items()], "node_id string, address string, status string")
    points = ring(spark, list(nodes)).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_points"))
    return listed.join(points, "node_id")


def merge_replicas(answers: DataFrame) -> DataFrame:
    """What nodes answered (series_key, ts, value, txn_id[, seq]) -> one row per (series, ts): the newest version.

    Replicas that lag behind hold older versions; those lose, whatever their value. Equal versions are one row; the greatest
    value of one version is kept, so the order of arrival never counts.
    """
    order = [c for c in ("txn_id", "seq", "value") if c in answers.columns]
    return newest(answers, ["series_key", "ts"], order)


def distributed_query(held: DataFrame, targets: list[str], failed: dict[str, str] | None = None) -> tuple[DataFrame, dict]:
    """Ask the target nodes for what they hold, leave out those that failed, and merge the answers.

    ``held`` has a row per (node_id, sample): what each node stores, in one scan for all nodes. ``failed`` is node -> error.
    Returns the merged rows and a report: nodes_queried, nodes_responded, errors, and whether the answer is complete.
    Windows of which every owner failed are missing from the rows.
    """
    failed = {n: e for n, e in (failed or {}).items() if n in targets}
    answering = [n for n in targets if n not in failed]
    rows = merge_replicas(held.where(F.col("node_id").isin(answering)).drop("node_id")) if answering else merge_replicas(held.where("false").drop("node_id"))
    report = {"nodes_queried": len(targets), "nodes_responded": len(answering), "errors": [f"{n}: {e}" for n, e in sorted(failed.items())], "complete": not failed}
    return rows, report
