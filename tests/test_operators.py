import pytest
from pyspark.sql import functions as F

from tidewell import queries
from tidewell.functions import bloom
from tidewell.model import series_key
from tidewell.operators import placement
from tidewell.operators.aggregate import aggregate, downsample
from tidewell.operators.rate import rate
from tidewell.operators.resolve import resolve_latest, visible
from tidewell.operators.scan import scan_labels, scan_series
from tidewell.plans.builder import build
from tidewell.plans.language import Query

SCHEMA = "series_key string, ts bigint, value double, txn_id bigint, seq bigint, is_deleted boolean"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def points(spark, *tv, key="cpu"):
    return spark.createDataFrame([(key, t, float(v), i, 0, False) for i, (t, v) in enumerate(tv)], SCHEMA)


def test_series_key(spark):
    df = spark.createDataFrame([("m", {"b": "2", "a": "1"}), ("m", {}), ("m", None), ("m", {"a": 'x"\\'}), (None, {"a": "1"})], "metric string, labels map<string,string>")
    assert [r[0] for r in df.select(series_key()).collect()] == ['m{a="1",b="2"}', "m", "m", 'm{a="x\\"\\\\"}', None]


def test_inclusive_ends_and_exact_series(spark):
    df = points(spark, (0, 1), (1000, 2), (2000, 3)).union(points(spark, (500, 9), key='cpu{host="a"}'))
    assert rows(scan_series(df, "cpu", 0, 2000), "ts") == [(0,), (1000,), (2000,)]
    lab = spark.createDataFrame([("cpu", {"h": "a", "z": "1"}, 5, 1.0), ("cpu", {"h": "b"}, 5, 2.0)], "metric string, labels map<string,string>, ts bigint, value double")
    assert rows(scan_labels(lab, "cpu", {"h": "a"}, 0, 10), "value") == [(1.0,)]


def test_buckets_truncate_toward_zero(spark):
    df = points(spark, (299_999, 1), (300_000, 2), (-1, 3), (1, 5))
    assert rows(downsample(df, 300_000, "SUM"), "ts", "value") == [(0, 9.0), (300_000, 2.0)]
    assert rows(downsample(df, 300_000, "RATE"), "ts", "value") == [(0, 1.0), (300_000, 2.0)]
    assert downsample(df, 0).count() == 4


@pytest.mark.parametrize("f", ["AVG", "SUM", "MIN", "MAX", "COUNT", "LAST"])
def test_empty_gives_no_row(spark, f):
    assert aggregate(points(spark, (1, 1)).where("false"), f).count() == 0


def test_aggregate_is_stamped_with_last_time(spark):
    df = points(spark, (5, 1), (9, 3), (7, 8))
    assert rows(aggregate(df, "LAST"), "ts", "value") == [(9, 3.0)]
    assert rows(aggregate(df, "COUNT"), "value") == [(3.0,)]
    with pytest.raises(ValueError):
        aggregate(df, "MEDIAN")


def test_rate(spark):
    assert rows(rate(points(spark, (0, 10), (1000, 4))), "ts", "value") == [(1000, 4.0)]
    assert rows(rate(points(spark, (0, 10), (1000, -5))), "value") == [(0.0,)]
    assert rate(points(spark, (0, 1))).count() == 0
    assert rate(points(spark, (0, 1), (0, 2))).count() == 0


def test_versions(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 5, 0, False), ("a", 1, 3.0, 3, 0, False), ("a", 1, 4.0, 4, 0, False), ("b", 1, 1.0, 1, 0, False), ("b", 1, 2.0, 1, 1, False), ("c", 1, 1.0, 1, 0, False), ("c", 1, 0.0, 2, 0, True)], SCHEMA)
    assert rows(resolve_latest(df), "series_key", "value") == [("a", 5.0), ("b", 2.0)]
    assert rows(resolve_latest(df.where(visible(1))), "series_key", "value") == [("b", 2.0), ("c", 1.0)]
    assert rows(resolve_latest(df.where(visible(9, (5,)))), "series_key", "value") == [("a", 4.0), ("b", 2.0)]
    assert resolve_latest(df, keep_tombstones=True).count() == 3


def test_build_pushes_filters_below_resolution(spark, tmp_path):
    points(spark, (0, 1), (1000, 2)).write.parquet(str(tmp_path / "s"))
    df = build(spark.read.parquet(str(tmp_path / "s")), Query("cpu", start=0, end=5000, downsample=1000, function="MAX"))
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(series_key)" in plan and "GreaterThanOrEqual(ts,0)" in plan
    assert rows(df, "ts", "value") == [(0, 1.0), (1000, 2.0)]


def test_ring(spark):
    nodes = ["n1", "n2", "n3", "n4"]
    assert placement.ring(spark, nodes).count() == 4 * 128
    keys = spark.range(60).select(F.concat(F.lit("partition-"), "id").alias("partition_key"))
    got = {r.partition_key: r.owners for r in placement.with_owners(keys, nodes).collect()}
    assert all(got[k] == placement.owners_of(k, nodes, 3) and len(set(got[k])) == 3 for k in got)
    less = {r.partition_key: r.owners for r in placement.with_owners(keys, nodes[:3]).collect()}
    assert all([n for n in got[k] if n != "n4"] == less[k][: len([n for n in got[k] if n != "n4"])] for k in got)
    assert placement.with_owners(keys, ["only"]).first().owners == ["only"]
    assert placement.with_owners(keys, []).first().owners == []
    w = placement.partition_for_time(spark.createDataFrame([(21_600_000,), (0,)], "ts bigint")).orderBy("ts").collect()
    assert (w[1].partition_key, w[1].start_time, w[1].end_time) == ("partition-1", 21_600_000, 43_199_999)
    assert placement.query_targets(spark, 0, 10 * 21_600_000, nodes).count() <= 4


def test_replica_merge(spark):
    a, b = points(spark, (0, 1), (1, 2)), points(spark, (1, 2), (2, 3))
    cols = ["series_key", "ts", "value"]
    assert rows(placement.merge_replicas(a.select(cols).unionByName(b.select(cols))), "ts", "value") == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_snapshot_near_the_head_resolves_the_whole_table(spark, tmp_path):
    n, hour, day = 2000, 3_600_000, 1_704_067_200_000
    events = [(i, day + (i * 7919) % 500 * (hour // 4), i % 50, "ab"[i % 2], float(i), "{}") for i in range(n)]
    df = spark.createDataFrame(events, "event_id bigint, ms bigint, user_id bigint, event_type string, value double, props string")
    df.select("event_id", F.timestamp_millis("ms").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    last = {}
    for i, t, _, kind, v, _ in events:
        if i <= n - 6 and i not in (n - 7, n - 21, n - 101):
            last[kind, t // hour * hour] = (v, i % 7 == 0)
    got = rows(queries.QUERIES["snapshot_near_head"](spark, str(tmp_path)), "series_key", "ts", "value")
    assert got == sorted((k, t, v) for (k, t), (v, gone) in last.items() if not gone) and max(r[2] for r in got) > n - 200


def test_bloom_filter_is_asked_for_keys_that_are_no_members(spark, tmp_path, monkeypatch):
    spark.range(300).select((F.col("id") * 3 % 150).alias("o_custkey")).union(spark.sql("SELECT CAST(NULL AS BIGINT)")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(200).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    sized, seen = [], {}
    size, ask = bloom.size, bloom.might_contain

    def asking(df, key, *rest):
        seen["asked"], seen["passed"] = df, ask(df, key, *rest)
        return seen["passed"]

    monkeypatch.setattr(bloom, "size", lambda n, *rate: sized.append(n) or size(n, *rate))
    monkeypatch.setattr(bloom, "might_contain", asking)
    assert queries.QUERIES["bloom_membership"](spark, str(tmp_path)).collect() == [(50, True)]
    assert sized == [50] and seen["asked"].count() == 400 and 50 <= seen["passed"].count() < 80
    monkeypatch.setattr(bloom, "size", lambda n, *rate: (64, 1))  # too small: much passes falsely
    assert queries.QUERIES["bloom_membership"](spark, str(tmp_path)).collect() == [(50, False)] and seen["passed"].count() > 80


def test_rate_over_shards_is_rate_over_the_series(spark):
    import random

    rng = random.Random(2)
    pts = sorted({(rng.choice("ab"), rng.randrange(-50_000, 50_000)) for _ in range(300)})
    df = spark.createDataFrame([(k, t, rng.choice([None, rng.uniform(0, 9)])) for k, t in pts], "series_key string, ts bigint, value double")
    key = lambda d: sorted((r.series_key, r.ts, round(r.value, 9)) for r in d.collect())
    assert key(rate(df, 1_000)) == key(rate(df, 10**9)) and rate(df.where("false")).count() == 0
