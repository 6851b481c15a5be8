"""Registered queries of the core, each with the SQL that gives the same rows.

Names ``pN_...`` belong to the training-data operators; the others exercise the time-series engine itself.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import model
from tidewell.api import Engine, flatten_json, respond
from tidewell.functions import bloom
from tidewell.functions.durations import instant_ms
from tidewell.operators import aggregate as A
from tidewell.operators import changes, heavykeys, lateness, placement, regrid, spikes
from tidewell.operators.rate import rate
from tidewell.operators.resolve import resolve_latest, visible
from tidewell.operators.scan import file_stats, list_series, overlaps, scan_series
from tidewell.plans.builder import build, describe
from tidewell.plans.language import Query as LanguageQuery
from tidewell.plans.language import parse
from tidewell.runtime import scratch_path
from tidewell.sources import binary
from tidewell.sources.files import CommitConflict
from tidewell.sources.store import SampleStore

Query = Callable[[SparkSession, str], DataFrame]

#: A fixed "now" for relative ranges and retention in the registered queries: 2024-01-31.
NOW_MS = instant_ms("2024-01-31")
JANUARY = "[2024-01-01:2024-01-31]"
START, END = instant_ms("2024-01-10"), instant_ms("2024-01-20")
NODES = ["node-a", "node-b", "node-c", "node-d", "node-e"]
DAY_MS, HOUR_MS = 86_400_000, 3_600_000

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def settled(c: Column) -> Column:
    """A floating sum or mean without the digits that depend on the order of addition."""
    return F.when(F.abs(c) < 1e6, F.round(c, 6)).otherwise(c.cast("float").cast("double"))


def settled_sql(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e6 THEN round({x}, 6) ELSE CAST(CAST({x} AS FLOAT) AS DOUBLE) END"


def sql_key(metric: str = "metric", labels: str = "labels") -> str:
    """DuckDB text of the canonical series key (label values without characters that need escaping)."""
    pairs = f"""list_transform(list_sort(map_keys({labels})), lambda z: z || '="' || {labels}[z] || '"')"""
    return f"CASE WHEN {labels} IS NULL OR cardinality({labels}) = 0 THEN {metric} ELSE {metric} || '{{' || array_to_string({pairs}, ',') || '}}' END"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def versioned(spark: SparkSession, root: str) -> DataFrame:
    """The events, each with an older version of another value and, for one in seven, a deleted one before that."""
    old = F.struct((-F.col("txn_id")).alias("txn_id"), (F.col("value") * 3 + 1).alias("value"), (F.col("txn_id") % 7 == 0).alias("is_deleted"))
    both = F.explode(F.array(F.struct("txn_id", "value", "is_deleted"), old)).alias("_v")
    return model.events_by_type(spark, root).select("metric", "series_key", "ts", both).select("metric", "series_key", "ts", "_v.*")


def ask(text: str) -> Query:
    return lambda spark, root: build(versioned(spark, root), parse(text, NOW_MS))


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small result (a report, an envelope) as a table."""
    return spark.createDataFrame(rows, schema)


# --- the engine's own operators --------------------------------------------------------------------------------------

EVENTS = "(SELECT event_type AS m, epoch_us(ts) // 1000 AS t, value AS v, event_id AS e, user_id AS u, props FROM events)"

register("scan_series_range", f"SELECT m AS series_key, t AS ts, v AS value FROM {EVENTS} WHERE m = 'click' AND t BETWEEN {START} AND {END}")(
    ask(f"click [{START // 1000}:{END // 1000}]")
)
register("scan_absolute_dates", f"SELECT m AS series_key, t AS ts, v AS value FROM {EVENTS} WHERE m = 'view' AND t BETWEEN {START} AND {END}")(
    ask("SELECT view [2024-01-10:2024-01-20]")
)
register("scan_default_range", f"SELECT m AS series_key, t AS ts, v AS value FROM {EVENTS} WHERE m = 'click' AND t BETWEEN {NOW_MS - HOUR_MS} AND {NOW_MS}")(
    ask("click")
)
register("scan_relative_range", f"SELECT m AS series_key, t AS ts, v AS value FROM {EVENTS} WHERE m = 'click' AND t BETWEEN {NOW_MS - 7 * DAY_MS} AND {NOW_MS}")(
    ask("click [7d]")
)
_AGG = {"avg": "avg(v)", "sum": "sum(v)", "min": "min(v)", "max": "max(v)", "count": "CAST(count(v) AS DOUBLE)", "last": "arg_max(v, t)"}
for _n, _f in _AGG.items():
    register(f"downsample_{_n}", f"SELECT m AS series_key, (t // 300000) * 300000 AS ts, {settled_sql(_f)} AS value FROM {EVENTS} GROUP BY 1, 2")(
        lambda spark, root, _n=_n: A.downsample(model.events_by_type(spark, root), 300_000, _n).withColumn("value", settled(F.col("value")))
    )
    register(f"aggregate_{_n}", f"SELECT m AS series_key, max(t) AS ts, {settled_sql(_f)} AS value FROM {EVENTS} WHERE t BETWEEN {START} AND {END} GROUP BY m")(
        lambda spark, root, _n=_n: A.aggregate(model.events_by_type(spark, root).where(F.col("ts").between(START, END)), _n).withColumn("value", settled(F.col("value")))
    )
register("downsample_default_is_avg", f"SELECT m AS series_key, (t // 3600000) * 3600000 AS ts, round(avg(v), 6) AS value FROM {EVENTS} WHERE m = 'click' GROUP BY 1, 2")(
    lambda spark, root: ask(f"click {JANUARY} DOWNSAMPLE 1h")(spark, root).withColumn("value", F.round("value", 6))
)
register("downsample_rate_is_last", f"SELECT m AS series_key, (t // 3600000) * 3600000 AS ts, arg_max(v, t) AS value FROM {EVENTS} WHERE m = 'click' GROUP BY 1, 2")(
    ask(f"click {JANUARY} DOWNSAMPLE 1h RATE")
)
register("downsample_zero_interval", f"SELECT m AS series_key, t AS ts, v AS value FROM {EVENTS} WHERE m = 'click'")(ask(f"click {JANUARY} DOWNSAMPLE 0m"))
register("downsample_empty_range", f"SELECT m AS series_key, t AS ts, v AS value FROM {EVENTS} WHERE t < 0")(ask("click [1:2] DOWNSAMPLE 5m SUM"))
register("aggregate_empty_range", f"SELECT m AS series_key, max(t) AS ts, CAST(count(v) AS DOUBLE) AS value FROM {EVENTS} WHERE t < 0 GROUP BY m")(ask("click [1:2] COUNT"))
_RATE = """SELECT m AS series_key, t AS ts, CASE WHEN r < 0 THEN greatest(0.0, v / s) ELSE r END AS value
 FROM (SELECT *, (v - pv) / s AS r FROM (SELECT *, (t - pt) / 1000e0 AS s FROM (
 SELECT m, t, v, lag(t) OVER w AS pt, lag(v) OVER w AS pv FROM {src} WINDOW w AS (PARTITION BY m ORDER BY t)) WHERE t > pt))"""
register("rate", "SELECT series_key, ts, round(value, 6) AS value FROM (" + _RATE.format(src=EVENTS) + ")")(
    lambda spark, root: rate(model.events_by_type(spark, root)).withColumn("value", F.round("value", 6))
)
register("rate_in_range", "SELECT series_key, ts, round(value, 6) AS value FROM (" + _RATE.format(src=f"(SELECT * FROM {EVENTS} WHERE m = 'click' AND t BETWEEN {START} AND {END})") + ")")(
    lambda spark, root: ask("click [2024-01-10:2024-01-20] RATE")(spark, root).withColumn("value", F.round("value", 6))
)
register(
    "resolve_latest",
    """SELECT 'order_total{priority="' || o_orderpriority || '"}' AS series_key, epoch_us(o_orderdate) // 1000 AS ts, arg_max(o_totalprice, o_orderkey) AS value, max(o_orderkey) AS txn_id
 FROM orders GROUP BY 1, 2""",
)(lambda spark, root: resolve_latest(model.orders_by_priority(spark, root)).select("series_key", "ts", "value", "txn_id"))


@register(
    "snapshot_and_tombstones",
    f"""SELECT m AS series_key, b AS ts, v AS value FROM (
 SELECT m, (t // 3600000) * 3600000 AS b, v, e % 7 = 0 AS d, row_number() OVER (PARTITION BY m, (t // 3600000) * 3600000 ORDER BY e DESC) AS rn
 FROM {EVENTS} WHERE e <= 900 AND e NOT IN (17, 170, 700)) WHERE rn = 1 AND NOT d""",
)
def _snapshot(spark: SparkSession, root: str) -> DataFrame:
    rows = model.events_by_type(spark, root).withColumn("is_deleted", F.expr("txn_id % 7 = 0")).withColumn("ts", F.expr("(ts div 3600000L) * 3600000L"))
    return resolve_latest(rows.where(visible(900, (17, 170, 700)))).select("series_key", "ts", "value")


@register(
    "snapshot_near_head",
    f"""SELECT m AS series_key, b AS ts, v AS value FROM (
 SELECT m, (t // 3600000) * 3600000 AS b, v, e % 7 = 0 AS d, row_number() OVER (PARTITION BY m, (t // 3600000) * 3600000 ORDER BY e DESC) AS rn
 FROM {EVENTS} CROSS JOIN (SELECT max(event_id) AS head FROM events) WHERE e <= head - 5 AND e NOT IN (head - 6, head - 20, head - 100)) WHERE rn = 1 AND NOT d""",
)
def _snapshot_near_head(spark: SparkSession, root: str) -> DataFrame:
    """As ``snapshot_and_tombstones``, but over nearly the whole table: the watermark lies just below its newest transaction."""
    events = model.events_by_type(spark, root)
    head = events.agg(F.coalesce(F.max("txn_id"), F.lit(0))).first()[0]
    rows = events.withColumn("is_deleted", F.expr("txn_id % 7 = 0")).withColumn("ts", F.expr("(ts div 3600000L) * 3600000L"))
    return resolve_latest(rows.where(visible(head - 5, (head - 6, head - 20, head - 100)))).select("series_key", "ts", "value")


register("series_list", f"SELECT DISTINCT m || '{{k=\"' || coalesce(json_extract_string(props, '$.k'), '') || '\",user=\"' || u || '\"}}' AS series_key FROM {EVENTS}")(
    lambda spark, root: list_series(model.events_by_label(spark, root))
)
register(
    "series_key_multi_label",
    f"SELECT e AS event_id, m || '{{k=\"' || coalesce(json_extract_string(props, '$.k'), '') || '\",user=\"' || u || '\"}}' AS series_key, t AS ts, v AS value FROM {EVENTS}",
)(lambda spark, root: model.events_by_label(spark, root).select(F.col("txn_id").alias("event_id"), "series_key", "ts", "value"))
_FILES = f"(SELECT t // 21600000 AS file_id, min(t) AS min_time, max(t) AS max_time, count(*) AS num_samples FROM {EVENTS} GROUP BY 1)"


def _files(spark: SparkSession, root: str) -> DataFrame:
    return file_stats(model.events_by_type(spark, root), F.expr("ts div 21600000L"))


register("overlap_prune", f"SELECT * FROM {_FILES} WHERE min_time <= {END} AND max_time >= {START}")(lambda spark, root: _files(spark, root).where(overlaps(START, END)))
register(
    "partition_for_time",
    f"SELECT e AS event_id, 'partition-' || (t // 21600000) AS partition_key, (t // 21600000) * 21600000 AS start_time, (t // 21600000) * 21600000 + 21599999 AS end_time FROM {EVENTS}",
)(lambda spark, root: placement.partition_for_time(model.events_by_type(spark, root)).select(F.col("txn_id").alias("event_id"), "partition_key", "start_time", "end_time"))


def _owner_sql() -> str:
    """The clockwise walk in SQL; DuckDB has no CRC, so the hashes of ring points and window names are listed by rule."""
    first, last = instant_ms("2024-01-01") // placement.WINDOW_MS, instant_ms("2024-02-01") // placement.WINDOW_MS
    points = ",".join(f"('{n}',{crc32(f'{n}-{i}'.encode())})" for n in NODES for i in range(placement.VIRTUAL_NODES))
    keys = ",".join(f"('partition-{i}',{crc32(f'partition-{i}'.encode())})" for i in range(first, last + 1))
    return f"""(SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY far, n) AS place FROM (
 SELECT k, n, min((h - kh + 4294967296) % 4294967296) AS far
 FROM (VALUES {keys}) AS w(k, kh), (VALUES {points}) AS r(n, h)
 WHERE k IN (SELECT 'partition-' || (t // 21600000) FROM {EVENTS}) GROUP BY k, n))"""


def _windows(spark: SparkSession, root: str) -> DataFrame:
    return placement.partition_for_time(model.events_by_type(spark, root)).select("partition_key").distinct()


register("owners", f"SELECT k AS partition_key, n AS node_id, CAST(place AS INTEGER) AS place FROM {_owner_sql()} WHERE place <= 3")(
    lambda spark, root: placement.with_owners(_windows(spark, root), NODES)
    .select("partition_key", F.posexplode("owners").alias("place", "node_id"))
    .select("partition_key", "node_id", (F.col("place") + 1).alias("place"))
)
_RANGES = {"one_window": (START, START + 1000), "two_windows": (START - 1000, START + 1000), "ten_days": (START, END), "before_1970": (-7 * DAY_MS, -1)}


def _targets_sql() -> str:
    """Per range the owners of its windows; the window names, their hashes and the ring are listed by rule."""
    points = ",".join(f"('{n}',{crc32(f'{n}-{i}'.encode())})" for n in NODES for i in range(placement.VIRTUAL_NODES))
    keys = ",".join(f"('{name}',{i},{crc32(f'partition-{i}'.encode())})" for name, (a, z) in _RANGES.items() for i in range(int(a / placement.WINDOW_MS), int(z / placement.WINDOW_MS) + 1))
    return f"""SELECT DISTINCT range, n AS node_id FROM (SELECT range, w, n, row_number() OVER (PARTITION BY range, w ORDER BY far, n) AS place FROM (
 SELECT range, w, n, min((h - kh + 4294967296) % 4294967296) AS far FROM (VALUES {keys}) AS k(range, w, kh), (VALUES {points}) AS r(n, h) GROUP BY 1, 2, 3)) WHERE place <= 3"""


@register("query_targets", _targets_sql())
def _query_targets(spark: SparkSession, root: str) -> DataFrame:
    """Nodes asked for a range: the owners of one window, of two, of ten days, and of a week before 1970."""
    out = None
    for name, (a, z) in _RANGES.items():
        part = placement.query_targets(spark, a, z, NODES).select(F.lit(name).alias("range"), "node_id")
        out = part if out is None else out.unionByName(part)
    return out


register("write_targets", f"SELECT n AS node_id, count(*) AS samples FROM {EVENTS} JOIN {_owner_sql()} ON k = 'partition-' || (t // 21600000) WHERE place <= 3 GROUP BY n")(
    lambda spark, root: placement.write_targets(model.events_by_type(spark, root), NODES).select(F.explode("owners").alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("samples"))
)


LAGGING = ("node-b", "node-d")


def _held(spark: SparkSession, root: str) -> DataFrame:
    """What every node stores, in one scan: its windows' points; nodes that lag behind still hold an older, greater value."""
    each = placement.write_targets(model.events_by_type(spark, root), NODES).select("series_key", "ts", "value", "txn_id", F.explode("owners").alias("node_id"))
    lags = F.col("node_id").isin(*LAGGING)
    return each.select("node_id", "series_key", "ts", F.when(lags, F.col("value") + 1000).otherwise(F.col("value")).alias("value"), F.when(lags, F.lit(-1)).otherwise(F.col("txn_id")).cast("bigint").alias("txn_id"))


def _answers_sql(failed: tuple[str, ...] = ()) -> str:
    alive = ",".join(f"'{n}'" for n in NODES if n not in failed)
    lags = ",".join(f"'{n}'" for n in LAGGING)
    return f"""SELECT m AS series_key, t AS ts, CASE WHEN bool_or(n NOT IN ({lags})) THEN v ELSE v + 1000 END AS value
 FROM {EVENTS} JOIN {_owner_sql()} ON k = 'partition-' || (t // 21600000) WHERE place <= 3 AND n IN ({alive}) GROUP BY m, t, v"""


register("replica_merge", _answers_sql())(lambda spark, root: placement.merge_replicas(_held(spark, root).drop("node_id")).select("series_key", "ts", "value"))
_FAILED = {"node-a": "no answer in 5 s", "node-c": "connection refused"}
register("distributed_query", _answers_sql(tuple(_FAILED)))(
    lambda spark, root: placement.distributed_query(_held(spark, root), NODES, _FAILED)[0].select("series_key", "ts", "value")
)


@register("distributed_report", "SELECT 5 AS nodes_queried, 3 AS nodes_responded, 'node-a: no answer in 5 s; node-c: connection refused' AS errors, false AS complete")
def _distributed_report(spark: SparkSession, root: str) -> DataFrame:
    r = placement.distributed_query(_held(spark, root), NODES, _FAILED)[1]
    return rows_of(spark, [(r["nodes_queried"], r["nodes_responded"], "; ".join(r["errors"]), r["complete"])], "nodes_queried int, nodes_responded int, errors string, complete boolean")


_NODE_TABLE = {n: (f"10.0.0.{i}:9000", "down" if n in _FAILED else "up") for i, n in enumerate(NODES)}
register("node_info", "SELECT * FROM (VALUES " + ",".join(f"('{n}','{a}','{st}',CAST({placement.VIRTUAL_NODES} AS BIGINT))" for n, (a, st) in _NODE_TABLE.items()) + ") AS v(node_id, address, status, n_points)")(
    lambda spark, root: placement.node_info(spark, _NODE_TABLE)
)
_READINGS_SQL = """(SELECT request_id, agent, received_at, epoch_us(received_at) // 1000 AS arrived, s.metric AS metric, s.labels AS labels, CASE WHEN p.timestamp = 0 THEN epoch_us(received_at) // 1000 ELSE p.timestamp END AS ts, p.value AS value
 FROM (SELECT request_id, agent, received_at, s, unnest(s.samples) AS p FROM (SELECT request_id, agent, received_at, unnest(timeseries) AS s FROM write_requests)))"""


@register("write_request_ingest", f"SELECT {sql_key()} AS series_key, ts, count(*) AS deliveries, min(value) AS low, max(value) AS high FROM {_READINGS_SQL} GROUP BY 1, 2")
def _ingest(spark: SparkSession, root: str) -> DataFrame:
    """The JSON bodies of all write requests through the parser of the write interface."""
    table = model.read_table(spark, root, "write_requests")
    bodies = table.select(F.to_json(F.struct("timeseries")).alias("body"), model.time_ms("cast(received_at AS timestamp_ntz)").alias("now"))
    flat = flatten_json(bodies, "body", F.col("now"))
    return flat.groupBy(model.series_key().alias("series_key"), "ts").agg(F.count(F.lit(1)).alias("deliveries"), F.min("value").alias("low"), F.max("value").alias("high"))


register(
    "samples_current_state",
    f"""SELECT series_key, ts, value, txn_id FROM (SELECT {sql_key()} AS series_key, ts, value, txn_id, is_deleted,
 row_number() OVER (PARTITION BY {sql_key()}, ts ORDER BY txn_id DESC, sample_id DESC) AS rn FROM samples) WHERE rn = 1 AND NOT is_deleted""",
)(
    lambda spark, root: resolve_latest(
        model.read_table(spark, root, "samples").select(model.series_key().alias("series_key"), "ts", "value", "txn_id", F.col("sample_id").alias("seq"), "is_deleted")
    ).select("series_key", "ts", "value", "txn_id")
)

# --- the store: every query writes a store of its own into the shared folder ---------------------------------------


def _store(spark: SparkSession, root: str, commits: int = 3) -> SampleStore:
    """The events in several commits; the same points are rewritten by a last commit with doubled values for one type."""
    store = SampleStore(spark, scratch_path(spark, "store"), bucket_ms=7 * DAY_MS)
    rows = read_events(spark, root)
    for i in range(commits):
        store.write(rows.where(F.pmod("user_id", F.lit(commits)) == i))
    store.write(rows.where("metric = 'click'").withColumn("value", F.col("value") * 2))
    return store


def read_events(spark: SparkSession, root: str) -> DataFrame:
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"))
    return model.read_table(spark, root, "events").select(F.col("event_type").alias("metric"), labels.alias("labels"), model.time_ms().alias("ts"), "value", "user_id")


_STORED = f"(SELECT m || '{{user=\"' || u || '\"}}' AS series_key, t AS ts, m, arg_max(v, e) AS v FROM {EVENTS} GROUP BY 1, 2, 3)"
_DOUBLED = f"SELECT series_key, ts, CASE WHEN m = 'click' THEN v * 2 ELSE v END AS value FROM {_STORED}"
_COLS = ["series_key", "ts", "value"]
register("store_read", _DOUBLED)(lambda spark, root: _store(spark, root).read().select(_COLS))
register("store_time_travel", f"SELECT series_key, ts, v AS value FROM {_STORED}")(lambda spark, root: _store(spark, root).read(version=3).select(_COLS))
register("store_query_range", f"SELECT series_key, max(ts) AS ts, CAST(count(value) AS DOUBLE) AS value FROM ({_DOUBLED}) WHERE series_key = 'view{{user=\"7\"}}' AND ts BETWEEN {START} AND {END} GROUP BY 1")(
    lambda spark, root: Engine(_store(spark, root), clock=lambda: NOW_MS).query('view{user="7"} [2024-01-10:2024-01-20] COUNT')
)


@register("store_delete", f"SELECT * FROM ({_DOUBLED}) WHERE NOT (series_key = 'click{{user=\"7\"}}' AND ts BETWEEN {START} AND {END})")
def _store_delete(spark: SparkSession, root: str) -> DataFrame:
    store = _store(spark, root)
    store.delete('click{user="7"}', START, END)
    return store.read().select(_COLS)


@register("store_compact", f"SELECT * FROM ({_DOUBLED}) WHERE NOT (series_key = 'click{{user=\"7\"}}' AND ts BETWEEN {START} AND {END})")
def _store_compact(spark: SparkSession, root: str) -> DataFrame:
    """After compaction of both strategies nothing but the files has changed, and no superseded row is left."""
    store = _store(spark, root)
    store.delete('click{user="7"}', START, END)
    store.compact_windows(window_ms=10**13, least=2)
    store.compact_level(1)
    return store.snapshot().select(_COLS)


#: A cut-off on the edge of a bucket: every file lies within one, so whole files go or stay, however a bucket is split.
_CUT = (NOW_MS - 14 * DAY_MS) // (7 * DAY_MS) * (7 * DAY_MS)


@register("store_retention", f"SELECT * FROM ({_DOUBLED}) WHERE ts >= {_CUT}")
def _store_retention(spark: SparkSession, root: str) -> DataFrame:
    store = _store(spark, root)
    store.expire(_CUT + 14 * DAY_MS, 14 * DAY_MS)
    return store.read().select(_COLS)


_WRITTEN = f"(SELECT t, m, u % 3 AS c FROM {EVENTS} UNION ALL SELECT t, m, 3 FROM {EVENTS} WHERE m = 'click')"


@register("store_status", f"SELECT count(*) AS total_samples, true AS has_bytes, true AS has_files FROM {_WRITTEN}")
def _store_status(spark: SparkSession, root: str) -> DataFrame:
    st = _store(spark, root).status()
    return rows_of(spark, [(st["total_samples"], st["total_bytes"] > 0, st["sstable_count"] > 0)], "total_samples bigint, has_bytes boolean, has_files boolean")


@register(
    "store_levels",
    f"""SELECT 'written' AS at, 0 AS level, count(*) AS samples, min(t) AS min_time, max(t) AS max_time, 0 AS wants_compaction FROM {_WRITTEN}
 UNION ALL SELECT 'compacted', 1, count(DISTINCT (series_key, ts)), min(ts), max(ts), NULL FROM {_STORED}""",
)
def _store_levels(spark: SparkSession, root: str) -> DataFrame:
    """Rows and times of each level, and the level that is over its limit, before and after compaction."""
    store = _store(spark, root)
    out = []
    for at in ("written", "compacted"):
        sizes = {level: (sum(f.rows for f in store.files() if f.level == level), v["min_time"], v["max_time"]) for level, v in store.levels().items()}
        out += [(at, level, *v, store.needs_compaction()) for level, v in sizes.items()]
        store.compact_level(0)
    return rows_of(spark, out, "at string, level int, samples bigint, min_time bigint, max_time bigint, wants_compaction int")


@register(
    "store_maintain",
    f"""WITH f AS (SELECT c, t // {7 * DAY_MS} AS b, min(t) AS lo, max(t) AS hi FROM {_WRITTEN} GROUP BY 1, 2),
 w AS (SELECT lo // {DAY_MS} AS w FROM f WHERE hi >= {_CUT} GROUP BY 1 HAVING count(*) >= 3)
 SELECT (SELECT count(*) FROM f WHERE hi < {_CUT}) AS expired, (SELECT count(*) FROM w) AS compacted""",
)
def _store_maintain(spark: SparkSession, root: str) -> DataFrame:
    """Retention, then one round of window compaction; a write of this size is one file per bucket."""
    store = _store(spark, root)
    done = store.maintain(_CUT + 14 * DAY_MS, ttl_ms=14 * DAY_MS, window_ms=DAY_MS)
    return rows_of(spark, [(done["expired"], done["compacted"])], "expired bigint, compacted bigint")


_SHIFT = instant_ms("2024-01-15")


def _shifted(spark: SparkSession, root: str) -> SampleStore:
    """The events moved so that half of them lie before 1970."""
    store = SampleStore(spark, scratch_path(spark, "store"), bucket_ms=DAY_MS)
    store.write(read_events(spark, root).withColumn("ts", F.col("ts") - _SHIFT))
    return store


register(
    "store_negative_times",
    f"""SELECT series_key, (ts // 3600000 + CASE WHEN ts < 0 AND ts % 3600000 <> 0 AND ts // 3600000 < 0 AND (ts // 3600000) * 3600000 < ts THEN 1 ELSE 0 END) * 3600000 AS ts, max(v) AS value
 FROM (SELECT series_key, ts - {_SHIFT} AS ts, v FROM {_STORED}) WHERE series_key = 'view{{user="7"}}' AND ts BETWEEN {-9 * DAY_MS} AND {6 * DAY_MS + 1234} GROUP BY 1, 2""",
)(lambda spark, root: Engine(_shifted(spark, root)).frame(LanguageQuery("view", {"user": "7"}, -9 * DAY_MS, 6 * DAY_MS + 1234, HOUR_MS, "MAX")))
register(
    "store_only_negative_times",
    f"SELECT series_key, ts, v AS value FROM (SELECT series_key, ts - {_SHIFT} AS ts, v FROM {_STORED}) WHERE series_key = 'view{{user=\"7\"}}' AND ts BETWEEN {-9 * DAY_MS} AND -1",
)(lambda spark, root: Engine(_shifted(spark, root)).frame(LanguageQuery("view", {"user": "7"}, -9 * DAY_MS, -1)))


@register(
    "store_transactions",
    """SELECT * FROM (VALUES (1, 'committed', 1), (2, 'aborted', 1), (3, 'committed', 2), (4, 'refused', 2), (5, 'repeated', 2), (6, 'single', 3)) AS v(step, outcome, live)""",
)
def _store_transactions(spark: SparkSession, root: str) -> DataFrame:
    """What each step of a small history does, and how many points are live after it."""
    store = SampleStore(spark, scratch_path(spark, "store"))
    one = lambda ts, v: rows_of(spark, [("cpu", {"host": "a"}, ts, v)], "metric string, labels map<string,string>, ts bigint, value double")
    out = []

    def note(step: int, outcome: str) -> None:
        out.append((step, outcome, store.read().count()))

    note(1, "committed" if store.write(one(1, 1.0)) == 1 else "failed")
    note(2, "aborted" if store.begin() == 2 else "failed")
    seen = store.versions()[-1]
    note(3, "committed" if store.write(one(2, 2.0), batch_id="b") == 3 else "failed")
    try:
        store.write(one(3, 3.0), based_on=seen)
        note(4, "committed")
    except CommitConflict:
        note(4, "refused")
    note(5, "repeated" if store.write(one(9, 9.0), batch_id="b") is None else "failed")
    note(6, "single" if store.write_sample("cpu", {"host": "a"}, 3, 3.0) else "failed")
    return rows_of(spark, out, "step int, outcome string, live int")


_USER7 = f"SELECT 'view' AS metric, '7' AS user, ts / 1000e0 AS seconds, v AS value FROM {_STORED} WHERE series_key = 'view{{user=\"7\"}}'"


def _points(spark: SparkSession, answer: dict) -> DataFrame:
    rows = [(r["metric"]["__name__"], r["metric"].get("user"), t, float(v)) for r in answer["data"]["result"] for t, v in r["values"]]
    return rows_of(spark, rows, "metric string, user string, seconds double, value double")


@register("json_points", _USER7 + f" AND ts BETWEEN {START} AND {END}")
def _json_points(spark: SparkSession, root: str) -> DataFrame:
    """The envelope of GET query; its number texts are read back."""
    engine = Engine(_store(spark, root), clock=lambda: NOW_MS)
    return _points(spark, respond(engine, "GET", "/api/v1/query", {"query": 'view{user="7"} [2024-01-10:2024-01-20]'})[1])


@register("json_query_range", _USER7 + f" AND ts BETWEEN {START} AND {START + 3 * DAY_MS}")
def _json_range(spark: SparkSession, root: str) -> DataFrame:
    """start and end of query_range take the place of the query's own; step is ignored, an unreadable time too."""
    engine = Engine(_store(spark, root), clock=lambda: NOW_MS)
    asked = {"query": 'view{user="7"} [2024-01-10:2024-01-11]', "start": "soon", "end": "2024-01-13T00:00:00Z", "step": "15s"}
    return _points(spark, respond(engine, "GET", "/api/v1/query_range", asked)[1])


@register(
    "json_answers",
    """SELECT * FROM (VALUES ('write', 204, '-', '-'), ('write no samples', 400, 'error', 'no samples in the request'), ('write bad', 400, 'error', '?'), ('no query', 400, 'error', 'missing query parameter'),
 ('bad query', 400, 'error', '?'), ('empty', 200, 'success', '0'), ('series', 200, 'success', 'cpu,cpu{host="a"}'), ('status', 200, 'success', '3'), ('health', 200, 'ok', '-'), ('nothing', 404, 'error', '?')) AS v(call, code, status, detail)""",
)
def _json_answers(spark: SparkSession, root: str) -> DataFrame:
    """Codes and envelopes of the HTTP interface, call by call."""
    engine = Engine(SampleStore(spark, scratch_path(spark, "store")), clock=lambda: NOW_MS)
    body = '{"timeseries":[{"metric":"cpu","labels":{"host":"a"},"samples":[{"timestamp":5,"value":1.5},{"timestamp":0,"value":2}]},{"metric":"cpu","samples":[{"timestamp":7,"value":3}]}]}'
    get, post = (lambda path, **p: respond(engine, "GET", path, p)), (lambda b: respond(engine, "POST", "/api/v1/write", {}, b))
    calls = [
        ("write", post(body), lambda a: "-"),
        ("write no samples", post('{"timeseries":[]}'), lambda a: a["error"]),
        ("write bad", post("{"), lambda a: "?" if a["error"] else ""),
        ("no query", get("/api/v1/query"), lambda a: a["error"]),
        ("bad query", get("/api/v1/query", query="cpu{"), lambda a: "?" if a["error"] else ""),
        ("empty", get("/api/v1/query", query="mem [1h]"), lambda a: str(sum(len(r["values"]) for r in a["data"]["result"]))),
        ("series", get("/api/v1/series"), lambda a: ",".join(a["data"])),
        ("status", get("/api/v1/status"), lambda a: str(a["data"]["total_samples"])),
        ("health", get("/health"), lambda a: "-"),
        ("nothing", get("/api/v2/query"), lambda a: "?" if a["error"] else ""),
    ]
    return rows_of(spark, [(n, code, (a or {}).get("status", "-"), f(a)) for n, (code, a), f in calls], "call string, code int, status string, detail string")


register("explain_plan", """SELECT * FROM (VALUES (0, 'Downsample interval=300000ms function=MAX'), (1, 'Resolve newest version per (series, ts)'), (2, 'Scan series=cpu{host="a"} range=[0, 1000]')) AS v(depth, line)""")(
    lambda spark, root: rows_of(spark, [((len(x) - len(x.lstrip())) // 2, x.strip()) for x in describe(parse('cpu{host="a"} [0:1] DOWNSAMPLE 5m MAX', NOW_MS)).split("\n")], "depth int, line string")
)


def _logged(spark: SparkSession, root: str) -> DataFrame:
    return model.events_by_type(spark, root).select("series_key", "ts", "value", "txn_id", (F.col("txn_id") % 7 == 0).alias("is_deleted"))


@register("log_replay", f"SELECT m AS series_key, m AS metric, t AS ts, v AS value, e AS txn_id, e % 7 = 0 AS is_deleted FROM {EVENTS}")
def _log_replay(spark: SparkSession, root: str) -> DataFrame:
    """All events written as log segments that rotate, and replayed."""
    path = scratch_path(spark, "log")
    binary.write_log_segments(_logged(spark, root), path, 64_000).count()
    return binary.read_log_segments(spark, path).drop("labels", "file")


@register("log_truncate", f"SELECT count(*) AS samples, true AS some_went FROM (SELECT DISTINCT e FROM {EVENTS} WHERE e > (SELECT max(event_id) // 2 FROM events))")
def _log_truncate(spark: SparkSession, root: str) -> DataFrame:
    """Segments of old transactions go, and no younger one is lost."""
    path = scratch_path(spark, "log")
    rows = _logged(spark, root).repartitionByRange(8, "txn_id").sortWithinPartitions("txn_id")
    binary.write_log_segments(rows, path, 64_000).count()
    half = (rows.agg(F.coalesce(F.max("txn_id"), F.lit(0))).first()[0]) // 2
    gone = binary.truncate_log(spark, path, half)
    return binary.read_log_segments(spark, path).where(F.col("txn_id") > half).agg(F.count(F.lit(1)).alias("samples")).withColumn("some_went", F.lit(gone > 0))


register("sorted_files_read", f"SELECT m AS series_key, m AS metric, t AS ts, v AS value, e AS txn_id, e % 7 = 0 AS is_deleted FROM {EVENTS}")(lambda spark, root: binary.read_sorted_files(spark, _sorted(spark, root)).drop("labels", "file"))
register("sorted_files_scan", f"SELECT m AS series_key, t AS ts, v AS value, e AS txn_id FROM {EVENTS} WHERE m = 'click' AND t BETWEEN {START} AND {END}")(
    lambda spark, root: binary.scan_sorted_files(spark, _sorted(spark, root), "click", START, END).select("series_key", "ts", "value", "txn_id")
)


def _sorted(spark: SparkSession, root: str) -> str:
    path = scratch_path(spark, "sorted")
    binary.write_sorted_files(_logged(spark, root).repartitionByRange(6, "series_key", "ts"), path).count()
    return path


@register("bloom_membership", "SELECT count(DISTINCT o_custkey) AS members, true AS few_false FROM orders")
def _bloom(spark: SparkSession, root: str) -> DataFrame:
    """Customers that pass a filter of the order's customers and are among them: no member may be missing.

    Asked are the keys of both tables and as many beyond the greatest, which are no members. What passes falsely is removed by
    an exact join, and may be no more than 3 in 100 of the non-members (the filter is sized for 1).
    """
    orders = model.read_table(spark, root, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    known = model.read_table(spark, root, "customer").select("c_custkey").union(orders).where("c_custkey IS NOT NULL").distinct()
    least, most = known.agg(F.coalesce(F.min("c_custkey"), F.lit(0)), F.coalesce(F.max("c_custkey"), F.lit(0))).first()
    asked = known.union(known.select(F.col("c_custkey") + (most - least + 1)))
    bits, hashes = bloom.size(orders.where("c_custkey IS NOT NULL").count())
    passed = bloom.might_contain(asked, "c_custkey", bloom.build(orders, "c_custkey", bits, hashes), bits, hashes)
    both = asked.join(passed.withColumn("_p", F.lit(1)), "c_custkey", "left").join(orders.withColumn("_m", F.lit(1)), "c_custkey", "left")
    non = F.count_if(F.col("_m").isNull())
    return both.agg(F.count_if(F.expr("_p = 1 AND _m = 1")).alias("members"), (F.count_if(F.expr("_p = 1 AND _m IS NULL")) <= 0.03 * non + 3).alias("few_false"))


# --- training-data operators -----------------------------------------------------------------------------------------


@register("p1_found")
def _p1(spark: SparkSession, root: str) -> DataFrame:
    return spikes.faulty_rows(model.read_table(spark, root, "samples"), model.read_table(spark, root, "metric_info"))


@register(
    "p2_series_statistics",
    f"""WITH s AS (SELECT {sql_key()} AS series_key, ts, value, txn_id FROM samples WHERE NOT is_deleted AND value IS NOT NULL),
 l AS (SELECT series_key, ts, value, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC, txn_id DESC, value DESC) AS rn FROM s)
 SELECT a.series_key, n_rows, n_timestamps, min_value, max_value, {settled_sql("mean_value")} AS mean_value, l.ts AS last_ts, l.value AS last_value
 FROM (SELECT series_key, count(*) AS n_rows, count(DISTINCT ts) AS n_timestamps, min(value) AS min_value, max(value) AS max_value, avg(value) AS mean_value FROM s GROUP BY 1) a
 JOIN l ON l.series_key = a.series_key AND rn = 1""",
)
def _p2(spark: SparkSession, root: str) -> DataFrame:
    return heavykeys.series_statistics(model.read_table(spark, root, "samples")).withColumn("mean_value", settled(F.col("mean_value")))


_P3 = f"""WITH p AS (SELECT s.metric AS metric, s.labels AS labels, CASE WHEN p.timestamp = 0 THEN epoch_us(received_at) // 1000 ELSE p.timestamp END AS ts, p.value AS value
 FROM (SELECT received_at, s, unnest(s.samples) AS p FROM (SELECT received_at, unnest(timeseries) AS s FROM write_requests))),
 k AS (SELECT DISTINCT {sql_key("p.metric", "p.labels")} AS series_key, scrape_interval_ms AS i, (p.ts // scrape_interval_ms) * scrape_interval_ms AS slot
 FROM p JOIN metric_info m ON m.metric = p.metric WHERE p.value IS NOT NULL),
 g AS (SELECT series_key, i, unnest(range(min(slot), max(slot) + i, i)) AS slot_ms FROM k GROUP BY 1, 2)"""


@register("p3_found", _P3 + " SELECT g.series_key, g.slot_ms FROM g ANTI JOIN k ON k.series_key = g.series_key AND k.slot = g.slot_ms")
def _p3(spark: SparkSession, root: str) -> DataFrame:
    grid = regrid.regular_series(model.read_table(spark, root, "write_requests"), model.read_table(spark, root, "metric_info"))
    return grid.where("state <> 'observed'").select("series_key", "slot_ms")


@register("p3_grid")
def _p3_grid(spark: SparkSession, root: str) -> DataFrame:
    return regrid.regular_series(model.read_table(spark, root, "write_requests"), model.read_table(spark, root, "metric_info"))


_P4 = f"""SELECT * EXCLUDE (rn, is_deleted) FROM (SELECT *, row_number() OVER (PARTITION BY series_key, ts ORDER BY txn_id DESC, seq DESC) AS rn
 FROM (SELECT {sql_key()} AS series_key, ts, value, txn_id, seq, is_deleted FROM change_feed)) WHERE rn = 1 AND NOT is_deleted"""


@register("p4_found", f"SELECT series_key, ts, txn_id FROM ({_P4})")
def _p4(spark: SparkSession, root: str) -> DataFrame:
    return changes.current_state(model.read_table(spark, root, "change_feed")).select("series_key", "ts", "txn_id")


@register("p4_state", _P4)
def _p4_state(spark: SparkSession, root: str) -> DataFrame:
    return changes.current_state(model.read_table(spark, root, "change_feed"), batches=3).select("series_key", "ts", "value", "txn_id", "seq")


_P5 = f"""SELECT s.sample_id, s.metric, {sql_key("s.metric", "s.labels")} AS series_key, s.ts, s.value, s.txn_id, s.is_deleted, (s.ts // 900000) * 900000 AS period_start,
 coalesce(max(s.ts) OVER (PARTITION BY s.metric ORDER BY s.txn_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= (s.ts // 900000) * 900000 + 900000 + allowed_lateness_ms, false) AS is_late
 FROM samples s JOIN metric_info m ON m.metric = s.metric"""


@register("p5_found", f"SELECT sample_id FROM ({_P5}) WHERE is_late")
def _p5(spark: SparkSession, root: str) -> DataFrame:
    return lateness.late_rows(model.read_table(spark, root, "samples"), model.read_table(spark, root, "metric_info"))


@register(
    "p5_periods",
    f"""WITH c AS ({_P5}),
 t AS (SELECT *, row_number() OVER (PARTITION BY series_key, ts ORDER BY txn_id DESC, sample_id DESC) AS rn FROM c WHERE NOT is_late),
 a AS (SELECT metric, period_start, count(value) FILTER (rn = 1 AND NOT is_deleted) AS n_values, sum(value) FILTER (rn = 1 AND NOT is_deleted) AS s,
 min(value) FILTER (rn = 1 AND NOT is_deleted) AS min_value, max(value) FILTER (rn = 1 AND NOT is_deleted) AS max_value, count(*) FILTER (rn > 1) AS n_rewritten FROM t GROUP BY 1, 2),
 l AS (SELECT metric, period_start, count(*) AS n_late FROM c WHERE is_late GROUP BY 1, 2)
 SELECT coalesce(a.metric, l.metric) AS metric, coalesce(a.period_start, l.period_start) AS period_start, coalesce(n_values, 0) AS n_values, {settled_sql("s")} AS sum_value,
 min_value, max_value, coalesce(n_rewritten, 0) AS n_rewritten, coalesce(n_late, 0) AS n_late
 FROM a FULL JOIN l ON a.metric = l.metric AND a.period_start = l.period_start""",
)
def _p5_periods(spark: SparkSession, root: str) -> DataFrame:
    out = lateness.period_aggregates(model.read_table(spark, root, "samples"), model.read_table(spark, root, "metric_info"))
    return out.withColumn("sum_value", settled(F.col("sum_value")))


_I = lateness.IDLE_MS // lateness.TICK_MS


@register(
    "p5_source_periods",
    f"""WITH r AS (SELECT *, {sql_key()} AS series_key, arrived // {lateness.TICK_MS} AS tick, coalesce(agent, chr(0)) AS source FROM {_READINGS_SQL}),
 k AS (SELECT metric, source, tick, max(ts) AS top FROM r GROUP BY 1, 2, 3),
 g AS (SELECT metric, tick, max(top) OVER w AS mark, coalesce(lead(tick) OVER w, tick + {_I}) AS next FROM k WINDOW w AS (PARTITION BY metric, source ORDER BY tick)),
 l AS (SELECT metric, t, min(mark) AS low FROM (SELECT metric, mark, unnest(range(tick, least(next, tick + {_I}))) AS t FROM g) GROUP BY 1, 2),
 p AS (SELECT metric, t, max(low) OVER (PARTITION BY metric ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS passed FROM l),
 c AS (SELECT r.*, (ts // 900000) * 900000 AS period_start, coalesce(passed >= (ts // 900000) * 900000 + 900000 + coalesce(allowed_lateness_ms, 0), false) AS is_late
 FROM r LEFT JOIN p ON p.metric = r.metric AND p.t = r.tick LEFT JOIN metric_info i ON i.metric = r.metric WHERE value IS NOT NULL),
 n AS (SELECT *, row_number() OVER (PARTITION BY series_key, ts, is_late ORDER BY arrived DESC, request_id DESC, value DESC) AS rn FROM c)
 SELECT metric AS grp, period_start, count(*) FILTER (NOT is_late AND rn = 1) AS n_values, {settled_sql("sum(value) FILTER (NOT is_late AND rn = 1)")} AS sum_value,
 min(value) FILTER (NOT is_late AND rn = 1) AS min_value, max(value) FILTER (NOT is_late AND rn = 1) AS max_value,
 count(*) FILTER (NOT is_late AND rn > 1) AS n_rewritten, count(*) FILTER (is_late) AS n_late FROM n GROUP BY 1, 2""",
)
def _p5_sources(spark: SparkSession, root: str) -> DataFrame:
    """Readings of the write requests by metric, with the agents as sources: a period closes when every live agent has passed it."""
    info = model.read_table(spark, root, "metric_info").select(F.col("metric").alias("grp"), F.col("allowed_lateness_ms").alias("lateness_ms"))
    out = lateness.source_periods(regrid.arrivals(model.read_table(spark, root, "write_requests")), info)
    return out.withColumn("sum_value", settled(F.col("sum_value")))
