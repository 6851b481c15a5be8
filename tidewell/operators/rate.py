"""Per-second rate of change between consecutive points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of a time shard: one task orders the points of a series within it.
SHARD_MS = 21_600_000


def rate(df: DataFrame, shard_ms: int = SHARD_MS) -> DataFrame:
    """Slope per second at the later point of each pair of a series; non-advancing times give no row.

    A falling value is read as a counter that restarted at zero: ``max(0, value / dt)``.
    Points with a NULL value or ts are ignored; of points with equal ts the greatest value is carried.

    A series is cut into time shards, so that one that holds most points is not ordered in one task. The last point of each
    non-empty shard, one row per shard, is carried to the next; the join and the window share one exchange.
    """
    points = df.where("value IS NOT NULL AND ts IS NOT NULL").select("series_key", "ts", "value", F.expr(f"ts div {int(shard_ms)}L").alias("_shard"))
    tops = points.groupBy("series_key", "_shard", "ts").agg(F.max("value").alias("value")).groupBy("series_key", "_shard").agg(F.max("ts").alias("_t"), F.max_by("value", "ts").alias("_v"))
    line = W.partitionBy("series_key").orderBy("_shard")
    carried = tops.select("series_key", "_shard", F.lag("_t").over(line).alias("_t"), F.lag("_v").over(line).alias("_v"))
    w = W.partitionBy("series_key", "_shard").orderBy("ts", "value")
    pairs = points.join(carried.hint("shuffle_hash"), ["series_key", "_shard"]).select(
        "series_key", "ts", "value", F.coalesce(F.lag("ts").over(w), F.col("_t")).alias("prev_ts"), F.coalesce(F.lag("value").over(w), F.col("_v")).alias("prev_value")
    )
    dt = (F.col("ts") - F.col("prev_ts")) / F.expr("1000D")
    slope = (F.col("value") - F.col("prev_value")) / dt
    return pairs.where("ts > prev_ts").select("series_key", "ts", F.when(slope < 0, F.greatest(F.expr("0D"), F.col("value") / dt)).otherwise(slope).alias("value"))
