import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import distinct, packing, percentiles

SEEN = "seen_at timestamp_ntz, metric string, labels map<string,string>, word int, grouping string"


def test_bitmap_sizes_and_errors():
    m = distinct.bitmap_bits(100_000, 0.01)
    assert m & (m - 1) == 0 and distinct.relative_error(100_000, m) <= 0.01 and distinct.relative_error(0, m) == 0
    assert distinct.bitmap_bits(10**7, 0.01) > m


def test_estimates_keep_their_bound(spark):
    for n in (1, 50, 3_000, 40_000):
        df = spark.range(n * 2).select((F.col("id") % n).cast("string").alias("c"), F.lit("g").alias("g"))
        bits = distinct.bitmap_bits(50_000, 0.02)
        r = [x for x in distinct.distinct_counts(distinct.partial_bitmaps(df, ["g"], "c", bits), ["g"], bits).collect()]
        assert len(r) == 2 and all(abs(x.estimate - n) <= max(5 * x.rel_error * n, 1) and not x.saturated for x in r)


def test_parts_merge_to_the_whole(spark):
    df = spark.range(5000).select((F.col("id") % 700).cast("string").alias("c"), (F.col("id") % 3).alias("g"))
    whole = distinct.partial_bitmaps(df, ["g"], "c", 4096)
    parts = [distinct.partial_bitmaps(df.where(F.col("c") % 2 == i), ["g"], "c", 4096) for i in (0, 1)]
    rows = lambda x: sorted(map(tuple, x.select("g", "word", "mask").collect()))
    assert rows(distinct.merge([*parts, parts[0]], ["g"])) == rows(whole)


def test_client_counts_edge_cases(spark):
    import datetime as dt

    d = dt.datetime(2021, 3, 1, 23, 59)
    rows = [(d, "m", {"client": "a", "tenant": "t", "region": ""}, 1, "x"), (d, "m", {"client": "a", "region": "", "tenant": "t"}, 1, "x"), (d, "m", {"tenant": "t"}, 1, "x"), (d, None, None, 1, "x"), (d, "m", {"client": "b"}, 1, "x"), (None, "m", {"client": ""}, 1, "x")]
    got = distinct.client_counts(spark.createDataFrame(rows, SEEN)).collect()
    at = {(r.grouping, r.day, r.metric, r.tenant, r.region): round(r.estimate) for r in got}
    assert at[(0, "2021-03-01", "m", "t", "")] == 1 and at[(0, "2021-03-01", "m", None, None)] == 1
    assert at[(15, None, None, None, None)] == 3 and at[(7, None, None, None, None)] == 1
    assert distinct.client_counts(spark.createDataFrame([], SEEN)).count() == 0
    full = spark.range(5000).select(F.col("id").cast("string").alias("c"), F.lit(1).alias("g"))
    r = distinct.distinct_counts(distinct.partial_bitmaps(full, ["g"], "c", 64), ["g"], 64).first()
    assert r.saturated and r.estimate == pytest.approx(64 * math.log(64))


SAMPLES = "metric string, labels map<string,string>, ts bigint, value double, is_deleted boolean, n int, run string"


def test_percentiles(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for _ in range(9000):
        hot = rng.random() < 0.5
        lab = {"z": "a"} if hot else rng.choice([None, {}, {"z": "a", "h": "1"}, {"h": "2", "z": "b"}, {"h": None}])
        v = rng.choice([None, float("nan"), 1.0, 1.0, rng.gauss(0, 1), rng.gauss(50, 9), float("inf")])
        rows.append(("m" if hot else rng.choice(["m", "n", None]), lab, 1, v, rng.choice([False, False, False, None, True]), 1, "x"))
    want = defaultdict(list)
    for m, lab, _, v, d, *_ in rows:
        if d or v is None or math.isnan(v):
            continue
        want["metric", m or ""].append(v)
        for k, x in (lab or {}).items():
            want["label", f'{k}="{x or ""}"'].append(v)
    want = {k: sorted(v) for k, v in want.items()}
    df = spark.createDataFrame(rows, SAMPLES).repartition(5)
    for one_task, piece, gather in ((10**6, 1000, 1000), (300, 500, 40), (300, 200, 0)):
        monkeypatch.setattr(percentiles, "ONE_TASK", one_task)
        monkeypatch.setattr(percentiles, "PIECE", piece)
        monkeypatch.setattr(percentiles, "GATHER", gather)
        parts = [percentiles.sorted_runs(df.where(F.col("value").isNull() | (F.col("value") > 1) == x)) for x in (True, False)] if gather else [percentiles.sorted_runs(df)]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        got = {(r.kind, r.grp): r for r in percentiles.percentiles(both).collect()}
        for k, v in want.items():
            r = got[k]
            assert r.n == len(v) and [r.p50, r.p90, r.p95, r.p99] == [v[percentiles.rank_of(p, len(v))] for p in (50, 90, 95, 99)], k
        assert sum(r.n for k, r in got.items() if k[0] == "series") == sum(len(v) for k, v in want.items() if k[0] == "metric")
    assert percentiles.percentiles(percentiles.sorted_runs(spark.createDataFrame([], SAMPLES))).count() == 0


def packed(spark, sizes, **kw):
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "doc_id bigint, source string, n_tokens bigint")
    return packing.pack_sized(df, **kw).toPandas()


def test_packing_invariants(spark):
    rng = np.random.default_rng(1)
    sizes = [(str(rng.choice(["a", "b", "c"], p=[0.6, 0.3, 0.1])) if rng.random() < 0.95 else None, int(rng.choice([0, 5, 40, 99, 100, 101, 230, 300, int(rng.integers(1, 90))]))) for _ in range(3000)]
    p = packed(spark, sizes, capacity=100, shard_tokens=40_000)
    assert p.groupby("doc_id").n_tokens.sum().reindex(range(3000)).tolist() == [n for _, n in sizes]
    full = p[p.container_id.notna()].groupby("container_id").n_tokens.sum()
    assert full.max() <= 100 and full.sum() / (len(full) * 100) > 0.97
    for d, g in p.groupby("doc_id"):
        n = sizes[d][1]
        assert len(g) == max(1, -(-n // 100)) and sorted(g.token_start) == list(range(0, max(n, 1), 100))
    assert p[p.n_tokens == 0].container_id.isna().all()
    w = p[p.window_id.notna()].copy()
    w["source"] = [sizes[d][0] or "-" for d in w.doc_id]
    share = w.pivot_table(index="window_id", columns="source", values="n_tokens", aggfunc="sum").fillna(0)
    big = share[share.sum(axis=1) > 5000]
    rest = [n % 100 for s, n in sizes if s == "a"]
    target = sum(rest) / sum(n % 100 for _, n in sizes)
    assert ((big["a"] / big.sum(axis=1) - target).abs() < 0.05).all()


def test_packing_follows_a_mixture_until_a_queue_is_dry(spark):
    p = packed(spark, [("a", 10)] * 2000 + [("b", 10)] * 2000, capacity=100, mixture={"a": 0.75, "b": 0.25}, shard_tokens=10**6)
    first = p[p.window_id == 0]
    assert abs((first.doc_id < 2000).mean() - 0.75) < 0.02 and len(p) == 4000
    assert len(packed(spark, [("a", 10)] * 3, capacity=100, mixture={"b": 1.0})) == 3
    assert len(packed(spark, [("a", 0)], capacity=10)) == 1
    empty = spark.createDataFrame([], "doc_id bigint, source string, text string, size_ int")
    assert packing.pack(empty).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a", "hello world", 1), (2, None, None, 1), (3, "a", "", 1), (4, "a", "word " * 50_000, 1)], "doc_id bigint, source string, text string, piece int")
    n = {r.doc_id: r.n_tokens for r in packing.count_tokens(df).collect()}
    assert n[1] >= 2 and n[2] == n[3] == 0 and n[4] >= 50_000
    assert packing.pack(df, capacity=1000).where("doc_id = 4").agg(F.sum("n_tokens")).first()[0] == n[4]


def test_repeated_doc_ids_are_pages_of_their_own(spark):
    df = spark.createDataFrame([(7, "a", 5000), (7, "a", 5000), (None, None, 4096), (8, "a", 10)], "doc_id bigint, source string, n_tokens bigint")
    p = packing.pack_sized(df, capacity=2048).toPandas()
    assert p.groupby("container_id").n_tokens.sum().max() <= 2048 and p.n_tokens.sum() == 5000 * 2 + 4096 + 10


def test_schedule_empties_queues_once():
    plan = packing.schedule({"a": 100, "b": 300, "c": 50}, {"a": 0.5, "b": 0.5})
    assert plan[0] == ("a", 0.0, 100.0, 0.0, 0.5) and plan[1][:1] + plan[1][2:] == ("b", 100.0, 0.0, 0.5)
    assert ("b", 100.0, 300.0, 200.0, 1.0) in plan and plan[-1] == ("c", 0.0, 50.0, 400.0, 1.0)
    assert packing.schedule({}, None) == [] and len(packing.schedule({"a": 5, "b": 7}, None)) == 2


def test_a_mixture_holds_over_partitions(spark):
    """With ten partitions b, at 80 %, runs dry once: before that every window has its share, after it there is none of b left."""
    rng = np.random.default_rng(3)
    sizes = [("a", int(n)) for n in rng.integers(20, 200, 4000)] + [("b", int(n)) for n in rng.integers(20, 200, 4000)]
    p = packed(spark, sizes, capacity=200, mixture={"a": 0.2, "b": 0.8}, shard_tokens=90_000)
    p["source"] = ["a" if d < 4000 else "b" for d in p.doc_id]
    w = p[p.window_id.notna()].pivot_table(index="window_id", columns="source", values="n_tokens", aggfunc="sum").fillna(0)
    w = w[w.sum(axis=1) > 0.9 * 200 * packing.WINDOW_CONTAINERS]
    share = w["b"] / w.sum(axis=1)
    mixed = share[share > 0.5]
    # 5/8 of all tokens are taken at 0.2 : 0.8
    assert abs(len(mixed) / len(share) - 0.625) < 0.08 and (mixed - 0.8).abs().median() < 0.02 and ((mixed - 0.8).abs() < 0.1).mean() > 0.95
    assert (share[share <= 0.5] < 0.1).mean() > 0.9


def test_bitmaps_are_sized_by_the_rows():
    assert distinct.sized_bits(1) == 8192 and distinct.sized_bits(10**6) < distinct.sized_bits(10**8)
    for n in (10, 10**4, 10**6):
        assert distinct.relative_error(n, distinct.sized_bits(n)) <= 0.01
