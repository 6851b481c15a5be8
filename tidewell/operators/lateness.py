"""Event-time periods with a per-source cut-off for late records.

A source's mark is the greatest event time seen in its earlier arrivals. A period is closed for a group once the mark of
every source that is not idle has passed the period's end by the allowed lateness; records that arrive afterwards are diverted.
``classify`` is the case of one source per group, in which every arrival moves the mark; ``source_periods`` that of several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.model import series_hash
from tidewell.runtime import join_small

PERIOD_MS = 900_000
#: Arrivals are taken in batches of this length where a group has several sources, and a source is idle after this long.
TICK_MS = 60_000
IDLE_MS = 1_800_000
#: Slices of the order axis at most; the rows of a slice grow beyond 50,000 only where there would be more.
MOST_SLICES = 4096


def order_slices(df: DataFrame, order: str, rows_per_slice: int, spread_by: list[str]) -> DataFrame:
    """Add ``_slice``, which ascends with ``order``, and ``_salt``: about ``rows_per_slice`` rows have the same pair.

    The axis is cut into slices of equal width; those that hold too many rows are cut again between their own least and
    greatest order, and so on, so outliers and dense stretches do not matter. Rows of one order always share a slice; where such
    a tie alone is too large it is salted by the content of ``spread_by``. At most ``MOST_SLICES`` overfull cells are listed on the
    driver at a time: beyond ``MOST_SLICES`` x ``rows_per_slice`` rows the slices grow with the data instead.
    """
    low, high, n = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    least = max(rows_per_slice, -(-n // MOST_SLICES))
    low, high = low or 0, high or 0

    def width(lo: int, hi: int, rows: int) -> int:
        return max(1, -(-(hi - lo + 1) * least // max(rows, 1)))

    first = width(low, high, n)
    if high - low < 2**63:
        slice_ = F.expr(f"(`{order}` - {low}L) div {first}L")
    else:  # halves, since the difference itself does not fit
        slice_ = F.expr(f"(shiftright(`{order}`, 1) - {low >> 1}L) div {max(1, first >> 1)}L")
    cut = df.withColumn("_slice", slice_).withColumn("_salt", F.lit(0))
    for _ in range(3):
        cells = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).where(F.col("n") > 2 * least)
        full = [(r[0], r.lo, width(r.lo, r.hi, r.n), -(-r.n // least) if r.lo == r.hi else 1) for r in cells.collect()]  # at most MOST_SLICES / 2 rows
        if not full:
            break
        dims = F.broadcast(df.sparkSession.createDataFrame(full, "_slice bigint, _lo bigint, _w bigint, _n bigint"))
        cut = (
            cut.join(dims, "_slice", "left")
            .withColumn("_slice", F.col("_slice") * (2 * MOST_SLICES) + F.coalesce(F.expr(f"(`{order}` - _lo) div _w"), F.lit(0)))
            .withColumn("_salt", F.when(F.col("_n") > 1, F.pmod(F.xxhash64(*spread_by), F.col("_n")).cast("int")).otherwise(F.col("_salt")))
            .drop("_lo", "_w", "_n")
        )
        if all(k > 1 for *_, k in full):
            break  # only ties were left
    return cut


def running_watermark(df: DataFrame, source: str, order: str, event_time: str, rows_per_slice: int = 50_000) -> DataFrame:
    """Add ``watermark``: the greatest ``event_time`` of the source's rows with a smaller ``order``; NULL if none.

    The order axis is cut into slices (see ``order_slices``), so no source is ordered in one task however
    large its share: slice maxima (a small aggregate) give each slice its starting mark, and only inside a
    (source, slice) rows are ordered. The join and the window share one exchange. ``source`` and ``order`` must not be NULL.
    """
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
    cut = order_slices(df, order, rows_per_slice, plain)
    key = [source, "_slice", "_salt"]
    ahead = W.partitionBy(source).orderBy("_slice").rangeBetween(W.unboundedPreceding, -1)
    marks = cut.groupBy(*key).agg(F.max(event_time).alias("_top")).select(*key, F.max("_top").over(ahead).alias("_carry"))
    # rows of one order do not count as earlier than each other, so a salted tie needs nothing but the carry
    within = W.partitionBy(*key).orderBy(F.greatest(F.col(order), F.lit(1 - 2**63))).rangeBetween(W.unboundedPreceding, -1)
    return cut.join(marks.hint("shuffle_hash"), key).withColumn("watermark", F.greatest(F.col("_carry"), F.max(event_time).over(within))).drop("_slice", "_salt", "_carry")


def low_watermarks(arrivals: DataFrame, idle_ticks: int) -> DataFrame:
    """Per (grp, tick): ``passed``, the event time that every live source of the group has passed before that tick.

    ``arrivals`` has (grp, source, tick, ts). A source's mark is the greatest ts it has sent so far; rows without a value
    (punctuations) move it like any other. The low watermark of a tick is the least mark of the sources that sent
    something in the last ``idle_ticks`` ticks; a source silent for longer no longer holds the others back. What has been passed
    stays passed. Rows exist for ticks with arrivals of the group; NULL where nothing was passed before.

    Each (source, tick) state is repeated for the ticks it stays in force, ``idle_ticks`` at most, and minima combine on
    the map side; windows only run over one row per tick.
    """
    at = arrivals.where("ts IS NOT NULL").groupBy("grp", "source", "tick").agg(F.max("ts").alias("top"))
    line = W.partitionBy("grp", "source").orderBy("tick")
    marks = at.select("grp", "tick", F.max("top").over(line.rowsBetween(W.unboundedPreceding, 0)).alias("mark"), F.lead("tick").over(line).alias("next"))
    until = F.least(F.coalesce(F.col("next"), F.col("tick") + idle_ticks), F.col("tick") + idle_ticks) - 1
    each = marks.withColumn("_until", until).select("grp", F.col("tick").alias("_from"), "mark", F.explode(F.sequence("tick", "_until")).alias("tick"))
    low = each.groupBy("grp", "tick").agg(F.min("mark").alias("low"), F.bool_or(F.col("_from") == F.col("tick")).alias("here"))
    before = W.partitionBy("grp").orderBy("tick").rowsBetween(W.unboundedPreceding, -1)
    return low.select("grp", "tick", "here", F.max("low").over(before).alias("passed")).where("here").drop("here")


def source_periods(readings: DataFrame, lateness: DataFrame, period_ms: int = PERIOD_MS, tick_ms: int = TICK_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """Periods of groups with several sources: grp, period_start, n_values, sum_value, min_value, max_value, n_rewritten, n_late.

    ``readings`` has (grp, source, series, ts, value, arrived_ms, arrival); ``lateness`` has (grp, lateness_ms). Arrivals are taken in
    ticks of ``tick_ms``, as a stream takes them in batches. A period closes for a group at the first tick before which every
    source not idle for ``idle_ms`` has passed its end by the lateness; rows of that and later ticks are late: counted in
    ``n_late``, and otherwise kept out. Of rows in time the latest arrival of a (series, ts) counts; the others are ``n_rewritten``.

    Rows without a value are punctuations: they move their source's mark and count nowhere. A NULL group or source is one of its
    own; groups without a lateness have 0; rows with NULL ts or arrival time are left out. Empty input gives no rows.
    """
    rows = readings.where("ts IS NOT NULL AND arrived_ms IS NOT NULL").withColumn("tick", F.expr(f"(arrived_ms - pmod(arrived_ms, {tick_ms}L)) div {tick_ms}L"))
    rows = rows.select(F.coalesce("grp", F.lit("\0")).alias("grp"), F.coalesce("source", F.lit("\0")).alias("source"), "series", "ts", "value", "arrival", "tick")
    marks = low_watermarks(rows, max(1, idle_ms // tick_ms))
    late = lateness.where("grp IS NOT NULL").groupBy("grp").agg(F.max("lateness_ms").alias("_late"))
    real = rows.where("value IS NOT NULL AND NOT isnan(value)").withColumn("period_start", F.col("ts") - F.pmod("ts", F.lit(period_ms)))
    timed = join_small(join_small(real, marks, ["grp", "tick"], "left"), late, "grp", "left")
    is_late = F.coalesce(F.col("passed") >= F.col("period_start") + period_ms + F.coalesce("_late", F.lit(0)), F.lit(False))
    # the newest arrival of each (series, ts) in time; late rows are only counted
    key = ["grp", "period_start", "is_late", "series", "ts"]
    top = timed.withColumn("is_late", is_late).groupBy(*key).agg(F.max_by("value", F.struct("arrival", "value")).alias("v"), F.count(F.lit(1)).alias("n"))
    timely = F.when(~F.col("is_late"), F.col("v"))
    out = top.groupBy("grp", "period_start").agg(
        F.count(timely).alias("n_values"),
        F.sum(timely).alias("sum_value"),
        F.min(timely).alias("min_value"),
        F.max(timely).alias("max_value"),
        F.coalesce(F.sum(F.when(~F.col("is_late"), F.col("n") - 1)), F.lit(0)).alias("n_rewritten"),
        F.coalesce(F.sum(F.when(F.col("is_late"), F.col("n"))), F.lit(0)).alias("n_late"),
    )
    return out.withColumn("grp", F.when(F.col("grp") != "\0", F.col("grp")))


def classify(samples: DataFrame, metric_info: DataFrame, period_ms: int = PERIOD_MS, default_lateness_ms: int = 0) -> DataFrame:
    """Per row of ``samples``: sample_id, metric, period_start, ts, value, txn_id, is_deleted, watermark, closed, is_late, series hashes.

    ``is_late`` says the row came after its period's cut-off for its metric (the source). Arrival order is
    ``txn_id``; rows of one transaction do not count as earlier than each other. Tombstones and NULL values advance
    the watermark like any row. Metrics without an entry get ``default_lateness_ms``; a NULL metric is a source
    of its own; a row with NULL ts is never late and moves no mark; a NULL txn_id counts as the first arrival.
    """
    h1, h2 = series_hash()
    info = metric_info.where("metric IS NOT NULL").groupBy("metric").agg(F.max("allowed_lateness_ms").alias("_late"))
    rows = samples.select(
        "sample_id",
        F.coalesce("metric", F.lit("\u0000")).alias("metric"),
        "ts",
        "value",
        F.coalesce("txn_id", F.lit(-1)).alias("txn_id"),
        F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"),
        h1.alias("_h1"),
        h2.alias("_h2"),
    )
    marked = running_watermark(rows, "metric", "txn_id", "ts")
    start = F.col("ts") - F.pmod("ts", F.lit(period_ms))
    return (
        join_small(marked, info, "metric", "left")
        .withColumn("period_start", start)
        .withColumn("is_late", F.coalesce(F.col("watermark") >= start + period_ms + F.coalesce("_late", F.lit(default_lateness_ms)), F.lit(False)))
        .withColumn("metric", F.when(F.col("metric") != "\u0000", F.col("metric")))
        .drop("_late")
    )


def late_rows(samples: DataFrame, metric_info: DataFrame, period_ms: int = PERIOD_MS) -> DataFrame:
    """The sample_id of each row that came after its cut-off (see ``classify``); reads four columns only."""
    slim = samples.select(
        "sample_id", "metric", "ts", "txn_id", F.lit(None).cast("map<string,string>").alias("labels"), F.lit(0.0).alias("value"), F.lit(False).alias("is_deleted")
    )
    return classify(slim, metric_info, period_ms).where("is_late").select("sample_id")


def period_aggregates(samples: DataFrame, metric_info: DataFrame, period_ms: int = PERIOD_MS) -> DataFrame:
    """Per metric and period: n_values, sum_value, min_value, max_value, n_rewritten, n_late.

    The first four are over the rows that came in time, as corrected by later ones in time: per (series, ts)
    the newest by (txn_id, sample_id) counts, so a repeated delivery counts once, a rewrite replaces and a tombstone
    removes. ``n_rewritten`` counts the in-time rows so superseded, ``n_late`` the rows after the cut-off, which
    change nothing else. Periods with only late or deleted rows appear with n_values 0.
    """
    rows = classify(samples, metric_info, period_ms).where("ts IS NOT NULL")
    timely = rows.where("NOT is_late").select("metric", "_h1", "_h2", "ts", "period_start", "value", "txn_id", "sample_id", "is_deleted")
    counted = timely.withColumn("_n", F.lit(1))
    top = counted.groupBy("metric", "period_start", "_h1", "_h2", "ts").agg(
        F.max_by(F.struct("value", "is_deleted"), F.struct("txn_id", "sample_id")).alias("_v"), F.count(F.lit(1)).alias("_n")
    )
    live = F.when(~F.col("_v.is_deleted") & ~F.isnan(F.coalesce(F.col("_v.value"), F.lit(float("nan")))), F.col("_v.value"))
    on_time = top.groupBy("metric", "period_start").agg(
        F.count(live).alias("n_values"),
        F.sum(live).alias("sum_value"),
        F.min(live).alias("min_value"),
        F.max(live).alias("max_value"),
        F.sum(F.col("_n") - 1).alias("n_rewritten"),
        F.lit(0).cast("bigint").alias("n_late"),
    )
    late = rows.where("is_late").groupBy("metric", "period_start").agg(F.count(F.lit(1)).alias("n_late"))
    none = F.lit(None).cast("double")
    both = on_time.unionByName(
        late.select(
            "metric", "period_start", F.lit(0).cast("bigint").alias("n_values"), none.alias("sum_value"), none.alias("min_value"), none.alias("max_value"), F.lit(0).cast("bigint").alias("n_rewritten"), "n_late"
        )
    )
    return both.groupBy("metric", "period_start").agg(
        F.sum("n_values").alias("n_values"),
        F.sum("sum_value").alias("sum_value"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.sum("n_rewritten").alias("n_rewritten"),
        F.sum("n_late").alias("n_late"),
    )
