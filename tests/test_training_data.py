"""Spikes, heavy keys, regular grid, change feeds and late events against brute force, with nulls, ties and odd columns."""

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import changes, heavykeys, lateness, regrid, spikes

SAMPLES = "sample_id bigint, metric string, labels map<string,string>, ts bigint, value double, txn_id bigint, is_deleted boolean, bucket string, shard int, m string"
INFO = "metric string, kind string, unit string, scrape_interval_ms bigint, allowed_lateness_ms bigint"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SAMPLES)


def info(spark, *rows):
    return spark.createDataFrame(list(rows), INFO)


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(3)
    out = []
    for i in range(600):
        hot = rng.random() < 0.5
        labels = {"a": "1"} if hot else rng.choice([None, {}, {"b": "2", "a": "1"}, {"a": "1", "b": "2"}])
        metric = rng.choice(["m1", "m2", None]) if not hot else "m1"
        value = rng.choice([None, float("nan"), 0.0, -1.5, 2.0, rng.random()])
        out.append((i, metric, labels, rng.choice([None, *range(0, 4_000_000, 50_000)]), value, rng.choice([None, i // 3, rng.randrange(200)]), rng.choice([False, False, False, True, None])))
    return out


def key(metric, labels):
    return metric if not labels or metric is None else metric + "{" + ",".join(f'{k}="{v}"' for k, v in sorted(labels.items())) + "}"


def test_heavy_keys(spark, some):
    want = defaultdict(list)
    for _, m, lab, ts, v, txn, d in some:
        if not d and ts is not None and v is not None and not math.isnan(v):
            want[key(m, lab)].append((ts, -(2**63) if txn is None else txn, v))
    got = {r.series_key: r for r in heavykeys.series_statistics(frame(spark, some)).collect()}
    assert set(got) >= {k for k in want if k}
    for k, rows in want.items():
        if k is None:
            continue
        r = got[k]
        assert (r.n_rows, r.n_timestamps, r.min_value, r.max_value) == (len(rows), len({t for t, *_ in rows}), min(v for *_, v in rows), max(v for *_, v in rows))
        assert r.mean_value == pytest.approx(sum(v for *_, v in rows) / len(rows)) and (r.last_ts, r.last_value) == (max(rows)[0], max(rows)[2])
    assert heavykeys.series_statistics(frame(spark, [])).count() == 0


def test_late_rows(spark, some):
    late = {"m1": 100_000, "m2": 500_000}
    want = set()
    for i, m, _, ts, _, txn, _ in some:
        if ts is None:
            continue
        before = [t for _, m2, _, t, _, x, _ in some if m2 == m and t is not None and (-1 if x is None else x) < (-1 if txn is None else txn)]
        if before and max(before) >= ts - ts % 900_000 + 900_000 + late.get(m, 0):
            want.add(i)
    mi = info(spark, ("m1", "gauge", None, None, 100_000), ("m2", "gauge", None, None, 500_000), (None, None, None, None, 5))
    for per_slice in (7, 50_000):
        df = frame(spark, some).select("sample_id", F.coalesce("metric", F.lit("?")).alias("g"), "ts", F.coalesce("txn_id", F.lit(-1)).alias("t"))
        marks = lateness.running_watermark(df, "g", "t", "ts", per_slice)
        assert marks.count() == len(some)
    assert {r[0] for r in lateness.late_rows(frame(spark, some), mi).collect()} == want and want
    per = lateness.period_aggregates(frame(spark, some), mi).collect()
    assert sum(r.n_late for r in per) == len(want)
    assert lateness.late_rows(frame(spark, []), mi).count() == 0 and lateness.period_aggregates(frame(spark, []), mi).count() == 0


def test_periods_count_corrections(spark):
    mi = info(spark, ("m", "gauge", None, None, 0))
    rows = [(1, "m", None, 10, 1.0, 1, False), (2, "m", None, 10, 5.0, 2, False), (3, "m", None, 20, 2.0, 3, False), (4, "m", None, 20, 2.0, 4, False), (5, "m", None, 30, 7.0, 5, False), (6, "m", None, 30, 0.0, 6, True), (7, "m", None, 2_000_000, 1.0, 7, False), (8, "m", None, 15, 9.0, 8, False)]
    r = {x.period_start: x for x in lateness.period_aggregates(frame(spark, rows), mi).collect()}[0]
    assert (r.n_values, r.sum_value, r.min_value, r.max_value, r.n_rewritten, r.n_late) == (2, 7.0, 2.0, 5.0, 3, 1)


REQUESTS = "request_id bigint, agent string, received_at timestamp, timeseries array<struct<metric:string,labels:map<string,string>,samples:array<struct<timestamp:bigint,value:double>>>>, slot int, shard int, step string"


def requests(spark, *points, metric="m"):
    at = dt.datetime(1970, 1, 1, 0, 1, tzinfo=dt.UTC)
    return spark.createDataFrame([(1, None, at, [(metric, None, list(points))], 1, 1, "x"), (2, "a", at, None, 1, 1, "x"), (3, "a", at, [], 1, 1, "x"), (4, "a", at, [("other", None, [(5, 1.0)])], 1, 1, "x")], REQUESTS)


def grid(df, mi, **kw):
    return sorted((r.slot_ms, r.state, r.value) for r in regrid.regular_series(df, mi, **kw).collect())


def test_grid(spark):
    mi = info(spark, ("m", "gauge", None, 10, 0), ("other", "gauge", None, None, 0), (None, "x", None, 5, 0))
    got = grid(requests(spark, (3, 1.0), (3, 1.0), (8, 3.0), (41, 6.0), (44, None), (55, float("nan")), (300, 7.0), (0, 8.0)), mi, max_fill=5)
    assert [g[0] for g in got] == list(range(0, 60_010, 10))
    assert got[0] == (0, "observed", 2.0) and [g[1] for g in got[:6]] == ["observed", "filled", "filled", "filled", "observed", "gap"]
    assert all(2.0 <= g[2] <= 6.0 for g in got[:5]) and got[1][2] < got[2][2] < got[3][2]
    assert got[-1] == (60_000, "observed", 8.0) and {g[2] for g in got if g[1] == "gap"} == {None}
    assert grid(requests(spark, (5, None)), mi) == [] and grid(requests(spark, (5, 1.0)), mi) == [(0, "observed", 1.0)]
    assert grid(requests(spark, (-5, 1.0), (15, 2.0)), mi)[0][0] == -10


def pchip(x, y, q):
    """Plain Fritsch-Carlson interpolation."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (w1 + w2) / (w1 / d[i - 1] + w2 / d[i])

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return 0.0 if s * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = np.clip(np.searchsorted(x, q, "right") - 1, 0, len(x) - 2)
    t = (q - x[i]) / h[i]
    return y[i] * (1 + 2 * t) * (1 - t) ** 2 + h[i] * m[i] * t * (1 - t) ** 2 + y[i + 1] * t * t * (3 - 2 * t) + h[i] * m[i + 1] * t * t * (t - 1)


@pytest.mark.parametrize("shard", [4, 7, 1000])
def test_grid_across_shards_is_the_plain_interpolation(spark, shard):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.integers(1, 9, 80))
    y = rng.normal(size=80).round(3)
    k = spark.createDataFrame([("s", 10, int(a), 1, float(b)) for a, b in zip(x, y, strict=True)], "series_key string, step bigint, slot bigint, n bigint, value double")
    got = sorted((r.slot_ms // 10, r.value) for r in regrid.to_grid(k, max_fill=100, shard_slots=shard).collect())
    q = np.arange(x[0], x[-1] + 1)
    assert [g[0] for g in got] == q.tolist()
    assert np.allclose([g[1] for g in got], pchip(x.astype(float), y, q.astype(float)))


FEED = "feed_pos bigint, arrived_at timestamp, metric string, labels map<string,string>, ts bigint, value double, txn_id bigint, seq int, is_deleted boolean, bucket int"


def test_change_feed(spark):
    rng = random.Random(4)
    feed = [(i, None, rng.choice(["a", "b", None]), rng.choice([None, {}, {"x": "1"}]), rng.choice([None, 1, 2]), rng.choice([None, 1.0]), rng.randrange(40), 0, rng.random() < 0.3, 9) for i in range(200)]
    feed = list({(r[2], str(r[3]), r[4], r[6]): r for r in feed}.values())
    best = {}
    for r in feed:
        k = (key(r[2], r[3]), r[4])
        if k not in best or r[6] > best[k][6] or (r[6] == best[k][6]):
            best[k] = r
    got = sorted((str(r.series_key), str(r.ts), r.txn_id) for r in changes.current_state(spark.createDataFrame(feed, FEED), batches=3).collect())
    sure = {k for k in best if len({(r[8]) for r in feed if (key(r[2], r[3]), r[4]) == k and r[6] == best[k][6]}) == 1}
    want = sorted((str(k[0]), str(k[1]), best[k][6]) for k in sure if not best[k][8])
    assert set(want) <= set(got)
    assert {(a, b) for a, b, _ in got} - {(a, b) for a, b, _ in want} <= {(str(a), str(b)) for a, b in set(best) - sure}
    assert changes.current_state(spark.createDataFrame([], FEED)).count() == 0


def series(rng, n, kind):
    t = np.cumsum(rng.integers(500, 1500, n))
    if kind == "counter":
        return t, np.cumsum(rng.integers(5, 15, n)).astype(float)
    if kind == "skewed":
        return t, np.exp(rng.normal(3, 0.5, n)).round(4)
    return t, (50 + 3 * np.sin(np.arange(n) / 200) + rng.normal(0, 1, n)).round(4)


def test_a_stretch_longer_than_shards_is_frozen(spark):
    rng = np.random.default_rng(9)
    t, v = series(rng, 20000, "gauge")
    v[6000:14000] = v[6000]  # fills whole shards and most of others
    v[14100] += 500.0
    quiet, flat = series(rng, 700, "gauge")[1], np.full(9000, 3.0)
    quiet[40:640] = quiet[40]
    rows = [(i, "g", None, int(t[i]), float(v[i]), i, False) for i in range(len(v))]
    rows += [(30000 + i, "q", None, int(t[i]), float(quiet[i]), i, False) for i in range(len(quiet))]
    rows += [(40000 + i, "k", None, int(t[i]), float(flat[i]), i, False) for i in range(len(flat))]
    mi = info(spark, *((m, "gauge", None, 1, 1) for m in "gqk"))
    got = {r[0] for r in spikes.faulty_rows(frame(spark, rows), mi).collect()}
    assert got == {*range(6000, 14000), 14100, *range(30040, 30640)}


def test_bursts_of_one_series_hide_no_spikes_of_another(spark):
    rng = np.random.default_rng(10)
    rows = []
    for k in range(3):
        t, v = series(rng, 1500, "gauge")
        if k == 0:
            v[20::20] += 30.0  # usual for this series
        else:
            v[700] += 18.0
        rows += [(2000 * k + i, "g", {"k": str(k)}, int(t[i]), float(v[i]), i, False) for i in range(len(v))]
    got = {r[0] for r in spikes.faulty_rows(frame(spark, rows), info(spark, ("g", "gauge", None, 1, 1))).collect()}
    assert got == {2700, 4700}


def test_spikes(spark):
    rng = np.random.default_rng(8)
    rows, want, sid = [], set(), 0
    for name, kind in (("c", "counter"), ("s", "skewed"), ("g", "gauge"), ("k", "constant")):
        n = 5200 if kind == "gauge" else 700
        t, v = series(rng, n, kind)
        bad = set()
        if kind == "counter":
            v[400:] -= v[400] - 3
            v[200], v[600] = v[200] * 50, -7.0
            bad = {200, 600}
        elif kind == "skewed":
            v[100] = 9e5
            bad = {100}
        elif kind == "gauge":
            v[3000:] += 15  # a lasting change of level
            v[500:503], v[2047], v[2048] = 90.0, 5.0, 4.0
            v[4000:4025] = v[4000]
            bad = {500, 501, 502, 2047, 2048, *range(4000, 4025)}
        else:
            v[:] = 7.0
            v[350:] = 9.0
        for i in range(n):
            copies = 2 if i in (500, 100) else 1
            for _ in range(copies):
                rows.append((sid, name, None, int(t[i]), float(v[i]), sid, False))
                if i in bad:
                    want.add(sid)
                sid += 1
    rows += [(sid, "g", None, 100, None, 1, False), (sid + 1, "g", None, 100, 1e9, 1, True), (sid + 2, "g", None, None, 1e9, 1, False), (sid + 3, None, None, 1, 1.0, 1, None)]
    mi = info(spark, ("c", "counter", "requests", 1, 0), ("s", "gauge", "seconds", 1, 0), ("g", "gauge", None, 1, 0))
    got = {r[0] for r in spikes.faulty_rows(frame(spark, rows), mi).collect()}
    assert got == want
    assert spikes.faulty_rows(frame(spark, []), mi).count() == 0
    assert [r[0] for r in spikes.faulty_rows(frame(spark, [(1, "s", None, 5, -3.0, 1, False)]), mi).collect()] == [1]


def test_slices_by_rows_whatever_the_order_ids(spark):
    """An outlier, one id for all rows and the ends of the number range leave no large slice, and the marks are right."""
    for ids in ([*range(3000), 10**18], [-1] * 3000, [-(2**63), 2**63 - 1, *range(500)]):
        df = spark.createDataFrame([("m", x, i) for i, x in enumerate(ids)], "g string, o bigint, t bigint")
        assert lateness.order_slices(df, "o", 200, ["t"]).groupBy("_slice", "_salt").count().agg(F.max("count")).first()[0] <= 400
        got = {r.t: r.watermark for r in lateness.running_watermark(df, "g", "o", "t", 200).collect()}
        want = {i: max((j for j, y in enumerate(ids) if y < x), default=None) for i, x in list(enumerate(ids))[::97]}
        assert len(got) == len(ids) and {i: got[i] for i in want} == want


def test_periods_of_several_sources(spark):
    rng = random.Random(6)
    tick, idle, period = lateness.TICK_MS, 5 * lateness.TICK_MS, 900_000
    rows = []
    for i in range(400):
        at = i * 40_000 + (10**7 if i > 200 else 0)
        source = rng.choice(["a", "b", None]) if i < 300 else "a"
        rows.append((rng.choice(["g", None]), source, rng.choice([1, 2]), at - rng.choice([0, 5_000, 2_000_000]), rng.choice([None, 1.0, rng.random()]), at, i))
    want: dict = {}
    for g in ("g", None):
        mine = [r for r in rows if r[0] == g]
        ticks = sorted({r[5] // tick for r in mine})
        passed, low = {}, None
        every = range(min(ticks), max(ticks) + 1)
        for t in every:
            passed[t] = low
            live = {}
            for s in ("a", "b", None):
                sent = [r for r in mine if r[1] == s and r[5] // tick <= t]
                if sent and max(r[5] // tick for r in sent) > t - idle // tick:
                    live[s] = max(r[3] for r in sent)
            if live:
                low = min(live.values()) if low is None else max(low, min(live.values()))
        newest: dict = {}
        for r in mine:
            if r[4] is None:
                continue
            p = r[3] - r[3] % period
            late = passed[r[5] // tick] is not None and passed[r[5] // tick] >= p + period + 60_000
            n = want.setdefault((g, p), [0, 0, 0])
            if late:
                n[2] += 1
            elif (g, r[2], r[3]) in newest:
                n[1] += 1
            else:
                newest[g, r[2], r[3]] = 1
                n[0] += 1
    df = spark.createDataFrame(rows, "grp string, source string, series int, ts bigint, value double, arrived_ms bigint, arrival int")
    late = spark.createDataFrame([("g", 60_000), ("\0", 60_000), (None, 7)], "grp string, lateness_ms bigint")
    got = {(r.grp, r.period_start): [r.n_values, r.n_rewritten, r.n_late] for r in lateness.source_periods(df, late, period, tick, idle).collect()}
    assert got == want and sum(n[2] for n in want.values()) > 0
    assert lateness.source_periods(df.where("false"), late).count() == 0


def test_shards_do_not_copy_dense_buckets(spark):
    df = spark.range(20_000).selectExpr("id AS sample_id", "1L AS h1", "2L AS h2", "id * 10 AS ts", "double(id % 7) AS value")
    n, core, shards = spikes._shards(df, 2048, 96).agg(F.count("*"), F.count_if("core"), F.countDistinct("shard")).first()
    assert n <= 1.1 * 20_000 and core == 20_000 and shards == 10
