"""Irregular readings onto a regular grid: shape-preserving monotone cubic interpolation per series.

Readings are reduced to one knot per series and period (an algebraic aggregate). A series' time axis is cut into
shards of ``shard_slots`` periods; the slopes at a knot need two neighbours on each side, so each shard receives the
two nearest knots of its neighbours as a halo, found over at most four border knots per shard. All further
work is windows over (series, shard), so no task holds more than a shard, however many rows a series has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.model import series_hash, series_key, time_ms
from tidewell.runtime import join_small

SHARD_SLOTS = 2048
#: Longest run of empty periods that is interpolated; longer ones are marked.
MAX_FILL = 10


def _flat(requests: DataFrame, *more: str) -> DataFrame:
    """One row per reading: (_now, more..., metric, labels, ts, value); timestamp 0 means ``received_at``."""
    now = time_ms("received_at" if dict(requests.dtypes)["received_at"] == "timestamp_ntz" else "to_timestamp_ntz(to_utc_timestamp(received_at, current_timezone()))")
    each = requests.select(now.alias("_now"), *more, F.explode("timeseries").alias("_s"))
    flat = each.select("_now", *more, F.col("_s.metric").alias("metric"), F.col("_s.labels").alias("labels"), F.explode("_s.samples").alias("_p"))
    return flat.select("_now", *more, "metric", "labels", F.when(F.col("_p.timestamp") == 0, F.col("_now")).otherwise(F.col("_p.timestamp")).alias("ts"), F.col("_p.value").alias("value"))


def readings(requests: DataFrame) -> DataFrame:
    """Flatten write requests to (metric, labels, ts, value)."""
    return _flat(requests).drop("_now")


def arrivals(requests: DataFrame) -> DataFrame:
    """Readings with their source and arrival: (grp, source, series, ts, value, arrived_ms, arrival).

    ``grp`` is the metric, ``source`` the agent, ``series`` two hashes of the series key, ``arrival`` orders by time, then request.
    """
    h1, h2 = series_hash()
    flat = _flat(requests, "request_id", "agent")
    return flat.select(
        F.col("metric").alias("grp"), F.col("agent").alias("source"), F.struct(h1.alias("h1"), h2.alias("h2")).alias("series"), "ts", "value", F.col("_now").alias("arrived_ms"), F.struct(F.col("_now").alias("at"), F.col("request_id").alias("id")).alias("arrival")
    )


def knots(points: DataFrame, metric_info: DataFrame) -> DataFrame:
    """One row (series_key, step, slot, n, value) per series and non-empty period; slot numbers periods.

    ``value`` is the mean of the period's readings, each (ts, value) counted once so that retried requests do not
    weigh twice. NULL and NaN values, NULL times and metrics without an interval give no knot.
    """
    info = metric_info.where("metric IS NOT NULL AND scrape_interval_ms > 0").groupBy("metric").agg(F.min("scrape_interval_ms").alias("step"))
    rows = join_small(points.where("ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)"), info, "metric")
    once = rows.select(series_key().alias("series_key"), "step", F.expr("(ts - pmod(ts, step)) div step").alias("slot"), "ts", "value").distinct()
    return once.groupBy("series_key", "step", "slot").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))


def with_halo(k: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Knots with ``shard`` and ``halo``: every shard's own knots and the two nearest ones before and after it."""
    own = k.withColumn("shard", F.expr(f"(slot - pmod(slot, {shard_slots}L)) div {shard_slots}L"))
    w = W.partitionBy("series_key", "shard")
    ranked = own.withColumn("_up", F.row_number().over(w.orderBy("slot"))).withColumn("_down", F.row_number().over(w.orderBy(F.desc("slot"))))
    border = ranked.where("_up <= 2 OR _down <= 2")
    line = W.partitionBy("series_key").orderBy("slot")
    # a border knot is wanted by the shards of the border knots one and two places away
    near = border.withColumn("_to", F.array(*[f("shard", i).over(line) for f in (F.lag, F.lead) for i in (1, 2)]))
    halo = near.select(*k.columns, "shard", F.explode(F.array_distinct("_to")).alias("_t")).where("_t IS NOT NULL AND _t <> shard")
    return own.withColumn("halo", F.lit(False)).unionByName(halo.select(*k.columns, F.col("_t").alias("shard"), F.lit(True).alias("halo")))


def _inner_slope(d0: Column, d1: Column, h0: Column, h1: Column) -> Column:
    """Weighted harmonic mean of two secants of one sign, else 0: no new extremum between knots."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 > 0, (w0 + w1) / (w0 / d0 + w1 / d1)).otherwise(F.lit(0.0))


def _end_slope(d0: Column, d1: Column, h0: Column, h1: Column) -> Column:
    """One-sided three-point slope at an end, limited so that the curve stays monotone there."""
    s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(s * d0 <= 0, F.lit(0.0)).when((d0 * d1 <= 0) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)


def to_grid(k: DataFrame, max_fill: int = MAX_FILL, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per series and period between its first and last knot: series_key, slot_ms, value, state, n_readings.

    ``state`` is ``observed``, ``filled`` (interpolated) or ``gap`` (value NULL: a run of more than ``max_fill`` empty
    periods). A segment is a run of knots without a longer gap; curves never use a knot across one. Exact knots
    keep their values, and a filled value never leaves the interval of its two neighbours.
    """
    w = W.partitionBy("series_key", "shard").orderBy("slot")
    at = lambda c, i: (F.lag(c, -i) if i < 0 else F.lead(c, i)).over(w)
    df = with_halo(k, shard_slots)
    df = df.select("*", at("slot", -1).alias("_s0"), at("value", -1).alias("_v0"), at("slot", 1).alias("_s2"), at("value", 1).alias("_v2"), at("slot", 2).alias("_s3"), at("value", 2).alias("_v3"))
    # a knot across a long gap is no neighbour
    far = lambda a, b: F.col(b) - F.col(a) - 1 > max_fill
    gap = F.coalesce(far("slot", "_s2"), F.lit(False))
    prev = F.col("_s0").isNotNull() & ~F.coalesce(far("_s0", "slot"), F.lit(False))
    nxt = F.col("_s3").isNotNull() & ~F.coalesce(far("_s2", "_s3"), F.lit(False))
    h0, h1, h2 = (F.col("slot") - F.col("_s0")).cast("double"), (F.col("_s2") - F.col("slot")).cast("double"), (F.col("_s3") - F.col("_s2")).cast("double")
    d0, d1, d2 = (F.col("value") - F.col("_v0")) / h0, (F.col("_v2") - F.col("value")) / h1, (F.col("_v3") - F.col("_v2")) / h2
    left = F.when(prev, _inner_slope(d0, d1, h0, h1)).when(nxt, _end_slope(d1, d2, h1, h2)).otherwise(d1)
    right = F.when(nxt, _inner_slope(d1, d2, h1, h2)).when(prev, _end_slope(d1, d0, h1, h0)).otherwise(d1)
    spans = df.where("NOT halo").select("series_key", "step", "slot", "n", "value", F.col("_s2").alias("next"), F.col("_v2").alias("next_value"), gap.alias("gap"), left.alias("m0"), right.alias("m1"))
    # periods of a span, in chunks so that an arbitrarily long gap never becomes one huge array
    last = F.coalesce(F.col("next"), F.col("slot") + 1) - 1
    chunk = spans.withColumn("_last", last).withColumn("_c", F.explode(F.expr(f"sequence(slot, _last, {shard_slots}L)")))
    each = chunk.withColumn("_slot", F.explode(F.expr(f"sequence(_c, least(_c + {shard_slots - 1}L, _last))")))
    h = (F.col("next") - F.col("slot")).cast("double")
    t = (F.col("_slot") - F.col("slot")) / h
    y0, y1 = F.col("value"), F.col("next_value")
    curve = y0 * (1 + 2 * t) * (1 - t) * (1 - t) + h * F.col("m0") * t * (1 - t) * (1 - t) + y1 * t * t * (3 - 2 * t) + h * F.col("m1") * t * t * (t - 1)
    curve = F.least(F.greatest(curve, F.least(y0, y1)), F.greatest(y0, y1))
    seen = F.col("_slot") == F.col("slot")
    return each.select(
        "series_key",
        (F.col("_slot") * F.col("step")).alias("slot_ms"),
        F.when(seen, y0).when(~F.col("gap"), curve).alias("value"),
        F.when(seen, "observed").when(F.col("gap"), "gap").otherwise("filled").alias("state"),
        F.when(seen, F.col("n")).otherwise(F.lit(0)).alias("n_readings"),
    )


def regular_series(requests: DataFrame, metric_info: DataFrame, max_fill: int = MAX_FILL) -> DataFrame:
    """Write requests -> regular series (see ``to_grid``). Empty input gives no rows."""
    return to_grid(knots(readings(requests), metric_info), max_fill)
