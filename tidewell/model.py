"""Data model: schemas, the canonical series key, and adapters to the sample layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType(), False),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType()), True),
        T.StructField("ts", T.LongType(), False),
        T.StructField("value", T.DoubleType(), True),
        T.StructField("txn_id", T.LongType(), True),
        T.StructField("is_deleted", T.BooleanType(), True),
    ]
)

WRITE_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField(
            "timeseries",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("metric", T.StringType()),
                        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
                        T.StructField(
                            "samples",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("timestamp", T.LongType()),
                                        T.StructField("value", T.DoubleType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def series_key(metric: Column | str = "metric", labels: Column | str = "labels", escape: bool = True) -> Column:
    """Canonical series key: ``metric`` or ``metric{a="x",b="y"}`` with labels sorted by name.

    NULL and empty label maps give the bare metric; a NULL metric gives NULL; a NULL label value counts as "".
    With ``escape`` backslashes and double quotes in values are escaped by a backslash.
    """
    metric = F.col(metric) if isinstance(metric, str) else metric
    labels = F.col(labels) if isinstance(labels, str) else labels

    def quoted(v: Column) -> Column:
        v = F.coalesce(v, F.lit(""))
        if escape:
            v = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('="'), v, F.lit('"'))

    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], quoted(e["value"])))
    return F.when(labels.isNull() | (F.size(labels) == 0), metric).otherwise(
        F.concat(metric, F.lit("{"), F.concat_ws(",", pairs), F.lit("}"))
    )


def series_hash(metric: Column | str = "metric", labels: Column | str = "labels") -> tuple[Column, Column]:
    """Two independent hashes (64 and 32 bits) of the series key, for shuffles that need not carry the strings.

    Labels are hashed as sorted entries, so the order inside the map does not matter.
    96 bits: even for 10^9 series the chance of any collision is below 10^-10.
    """
    metric = F.col(metric) if isinstance(metric, str) else metric
    labels = F.col(labels) if isinstance(labels, str) else labels
    entries = F.when(labels.isNotNull() & (F.size(labels) > 0), F.array_sort(F.map_entries(labels)))
    return F.xxhash64(metric, entries), F.hash(entries, metric)


def time_ms(ts_ntz: str = "ts") -> Column:
    """Milliseconds since the epoch of a zone-less timestamp, truncated, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts_ntz}) div 1000")


def events_by_type(spark: SparkSession, root: str) -> DataFrame:
    """``events`` as samples: one series per event type, no labels."""
    return read_table(spark, root, "events").select(
        F.col("event_type").alias("metric"),
        F.col("event_type").alias("series_key"),
        time_ms().alias("ts"),
        "value",
        F.col("event_id").alias("txn_id"),
        F.lit(False).alias("is_deleted"),
    )


def events_by_label(spark: SparkSession, root: str) -> DataFrame:
    """``events`` as samples with labels ``k`` (from the JSON properties) and ``user``."""
    labels = F.create_map(
        F.lit("user"),
        F.col("user_id").cast("string"),
        F.lit("k"),
        F.coalesce(F.get_json_object("props", "$.k"), F.lit("")),
    )
    out = read_table(spark, root, "events").select(
        F.col("event_type").alias("metric"),
        labels.alias("labels"),
        time_ms().alias("ts"),
        "value",
        F.col("event_id").alias("txn_id"),
        F.lit(False).alias("is_deleted"),
    )
    return out.withColumn("series_key", series_key())


def orders_by_priority(spark: SparkSession, root: str) -> DataFrame:
    """``orders`` as a versioned source: several orders share (priority, date); the order key is the version."""
    labels = F.create_map(F.lit("priority"), F.col("o_orderpriority"))
    out = read_table(spark, root, "orders").select(
        F.lit("order_total").alias("metric"),
        labels.alias("labels"),
        time_ms("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("txn_id"),
        F.lit(False).alias("is_deleted"),
    )
    return out.withColumn("series_key", series_key())
