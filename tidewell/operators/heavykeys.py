"""Per-key statistics when a few keys hold most rows.

Every step is an algebraic aggregate with fixed-width states, so Spark keeps it in bounded hash tables on the map side, which
spill, and shuffles partial states only:

* per key: count, sum, minimum, maximum and last time. One state per (map task, key) moves, whatever the key's share.
* distinct times per key: (key, ts) without any value is made unique first; that shuffle key holds ts, so a key's rows spread
  over all tasks. Both counts come from one scan: each row appears once per purpose and is told apart by a flag.
* the last value: rows at a key's last time are found by a join with the (small) result of the first step, and the newest of
  them wins.

Keys travel as two hashes; the strings come back with the rows at the last time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.model import series_hash, series_key
from tidewell.runtime import join_small, stored


def series_statistics(samples: DataFrame) -> DataFrame:
    """One row per series: n_rows, n_timestamps, min_value, max_value, mean_value, last_ts, last_value.

    Counted are rows with ``is_deleted`` not true, a ts and a value that is neither NULL nor NaN. ``mean_value`` is over
    those rows. ``last_value`` is that of the greatest ts; among rows of that ts the greatest (txn_id, value) wins,
    so ties give one defined result; a NULL txn_id ranks lowest. Series without such a row do not appear; an empty table
    gives no row; columns other than those named are ignored.
    """
    h1, h2 = series_hash()
    rows = samples.where("NOT coalesce(is_deleted, false) AND ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)").select(
        h1.alias("_h1"), h2.alias("_h2"), "metric", "labels", "ts", "value", F.coalesce("txn_id", F.lit(-(2**63))).alias("_txn")
    )
    # one scan for both: the row's time as part of the key, and its value under the key alone
    none, field = F.lit(None).cast("double"), lambda of_time, at, v, t: F.struct(F.lit(of_time).alias("of_time"), at.alias("at"), v.alias("v"), t.alias("t"))
    twice = F.array(field(True, F.col("ts"), none, F.lit(None).cast("bigint")), field(False, F.lit(0).cast("bigint"), F.col("value"), F.col("ts")))
    spread = rows.select("_h1", "_h2", F.explode(twice).alias("_x")).select("_h1", "_h2", "_x.*")
    states = spread.groupBy("_h1", "_h2", "of_time", "at").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("t").alias("t"))
    per_key = stored(
        states.groupBy("_h1", "_h2").agg(
            F.sum("n").alias("n_rows"),
            F.count_if("of_time").alias("n_timestamps"),
            F.min("lo").alias("min_value"),
            F.max("hi").alias("max_value"),
            (F.sum("s") / F.sum("n")).alias("mean_value"),
            F.max("t").alias("last_ts"),
        ),
        "heavy",
    )
    ends = per_key.select("_h1", "_h2", F.col("last_ts").alias("ts"))
    at_end = stored(join_small(rows, ends, ["_h1", "_h2", "ts"]).select("_h1", "_h2", series_key().alias("series_key"), "value", "_txn"), "ends")
    # newest transaction, then greatest value: two aggregates of fixed width instead of one over structs
    newest = at_end.groupBy("_h1", "_h2", "_txn").agg(F.max("value").alias("value"))
    last = newest.groupBy("_h1", "_h2").agg(F.max_by("value", "_txn").alias("last_value"))
    named = at_end.select("_h1", "_h2", "series_key").distinct()
    return per_key.join(last, ["_h1", "_h2"]).join(named, ["_h1", "_h2"]).select(
        "series_key", "n_rows", "n_timestamps", "min_value", "max_value", "mean_value", "last_ts", "last_value"
    )
