import json
import random

import pytest

from tidewell.api import Engine, override_range, respond
from tidewell.plans.language import Query
from tidewell.sources import binary
from tidewell.sources.changetable import ChangeTable
from tidewell.sources.files import CommitConflict, Folder
from tidewell.sources.store import SampleStore

BATCH = "metric string, labels map<string,string>, ts bigint, value double"


def batch(spark, *tv, metric="cpu", labels=None):
    return spark.createDataFrame([(metric, labels, t, float(v)) for t, v in tv], BATCH)


def live(store, **kw):
    return sorted((r.series_key, r.ts, r.value) for r in store.read(**kw).collect())


def test_store_versions_deletes_and_compaction(spark, tmp_path):
    s = SampleStore(spark, str(tmp_path / "s"), bucket_ms=10_000)
    assert live(s) == [] and s.status()["total_samples"] == 0
    s.write(batch(spark, (1, 1), (2, 2)))
    s.write(batch(spark, (2, 20), (15_000, 3)))
    s.delete("cpu", 1, 1)
    want = [("cpu", 2, 20.0), ("cpu", 15_000, 3.0)]
    assert live(s) == want
    assert live(s, version=1) == [("cpu", 1, 1.0), ("cpu", 2, 2.0)]
    assert s.snapshot(visible_up_to=1).count() == 2
    before = s.status()["sstable_count"]
    assert s.compact_windows(window_ms=10**9, least=2) == 1
    assert live(s) == want and s.status()["sstable_count"] < before and set(s.levels()) == {1}
    assert s.snapshot().where("is_deleted").count() == 0
    assert s.compact_windows() == 0
    assert s.vacuum() >= 1 and live(s) == want


def test_tombstone_stays_while_an_older_version_may_exist(spark, tmp_path):
    s = SampleStore(spark, str(tmp_path / "s"))
    s.write(batch(spark, (1, 1), (9, 9)))
    s.delete("cpu", 1, 1)
    s.delete("cpu", 9, 9)
    tomb = [f for f in s.files() if f.rows == 1]
    s._compact(tomb, 1)
    assert live(s) == [] and s.snapshot().where("is_deleted").count() == 2


def test_levels_retention_idempotence_and_refusals(spark, tmp_path):
    s = SampleStore(spark, str(tmp_path / "s"))
    for i in range(4):
        s.write(batch(spark, (i, i)), batch_id=f"b{i}")
    assert s.write(batch(spark, (3, 99)), batch_id="b3") is None
    assert s.needs_compaction() == 0
    s.compact_level(0)
    assert s.needs_compaction() is None and len(live(s)) == 4
    assert s.expire(now_ms=3 + 100, ttl_ms=100) == 0 and s.expire(now_ms=4 + 100, ttl_ms=100) == 1
    assert live(s) == [] and s.expire(10**15, 0) == 0
    with pytest.raises(ValueError):
        s.write(spark.createDataFrame([(None, None, 1, 1.0)], BATCH))
    assert s.write(batch(spark, (1, 1)).where("false")) is None
    s.begin()  # aborted
    s.write(batch(spark, (7, 7)))
    assert s.maintain(10, "leveled")["compacted"] == 0


def test_put_new_conflicts(spark, tmp_path):
    f = Folder(spark, str(tmp_path))
    f.put_new("log/000001.json", {"a": 1})
    with pytest.raises(CommitConflict):
        f.put_new("log/000001.json", {"a": 2})
    assert f.read("log/000001.json") == {"a": 1} and f.numbers("log") == [1] and f.names("nothing") == []


def test_json_interface(spark, tmp_path):
    e = Engine(SampleStore(spark, str(tmp_path / "s")), clock=lambda: 10_000)
    body = {"timeseries": [{"metric": "cpu", "labels": {"host": "a"}, "samples": [{"timestamp": 4000, "value": 1.5}, {"timestamp": 0, "value": 3}]}]}
    assert respond(e, "POST", "/api/v1/write", {}, json.dumps(body)) == (204, None)
    assert respond(e, "POST", "/api/v1/write", {}, '{"timeseries":[]}')[0] == 400
    assert respond(e, "POST", "/api/v1/write", {}, "{")[0] == 400
    code, out = respond(e, "GET", "/api/v1/query", {"query": 'cpu{host="a"} [1h]'})
    assert code == 200 and out["data"]["result"] == [{"metric": {"__name__": "cpu", "host": "a"}, "values": [[4.0, "1.5"], [10.0, "3"]]}]
    assert respond(e, "GET", "/api/v1/query", {"query": "cpu [1h]"})[1]["data"]["result"][0]["values"] == []
    assert respond(e, "GET", "/api/v1/query_range", {"query": 'cpu{host="a"}', "start": "3", "end": "x", "step": "9"})[0] == 200
    assert respond(e, "GET", "/api/v1/query", {})[0] == 400 and respond(e, "GET", "/api/v1/query", {"query": "!"})[0] == 400
    assert respond(e, "GET", "/api/v1/series", {})[1]["data"] == ['cpu{host="a"}']
    assert respond(e, "GET", "/health", {}) == (200, {"status": "ok"}) and respond(e, "GET", "/x", {})[0] == 404
    assert respond(e, "GET", "/api/v1/status", {})[1]["data"]["total_samples"] == 2
    assert override_range(Query("m", start=1, end=2), {"start": "5", "end": "?"}).start == 5000
    assert "Scan" in e.explain("cpu AVG")


def test_row_format_files(spark, tmp_path):
    rows = [('cpu{a="x,\\"y"}', -5, 1.25, 7, False), ("mem", 9, float("inf"), 8, True)]
    (tmp_path / "w").mkdir()
    good = b"".join(binary.log_record(binary.encode(*r)) for r in rows)
    (tmp_path / "w" / "1.wal").write_bytes(good + good[:-3])
    (tmp_path / "w" / "2.wal").write_bytes(good[:20])
    got = binary.read_log_segments(spark, str(tmp_path / "w")).orderBy("ts").collect()
    assert len(got) == 3 and got[0].labels == {"a": 'x,"y'} and got[0].metric == "cpu"
    (tmp_path / "1.sst").write_bytes(binary.sorted_file(rows, b"bloom", 42))
    (tmp_path / "2.sst").write_bytes(b"broken")
    got = binary.read_sorted_files(spark, str(tmp_path), magic=42).orderBy("ts").collect()
    assert [(r.series_key, r.ts, r.value, r.txn_id, r.is_deleted) for r in got] == rows
    assert binary.read_sorted_files(spark, str(tmp_path), magic=43).count() == 0


FEED = "k string, ts bigint, value double, txn_id bigint, seq int, is_deleted boolean"


def test_change_table_in_any_order(spark, tmp_path):
    rng = random.Random(1)
    feed = [(f"k{rng.randrange(5)}" if rng.random() < 0.9 else None, rng.randrange(4), rng.random(), t, s, rng.random() < 0.3) for t in range(60) for s in range(2)]
    want = {}
    for r in feed:
        want[r[:2]] = r
    want = sorted((str(r[0]), *r[1:5]) for r in want.values() if not r[5])
    for seed in range(2):
        rng = random.Random(seed)
        mixed = feed + rng.sample(feed, 30)
        rng.shuffle(mixed)
        t = ChangeTable(spark, str(tmp_path / f"t{seed}"), ["k", "ts"], ["txn_id", "seq"], buckets=4)
        assert t.read() is None
        for i in range(0, len(mixed), 50):
            t.apply(spark.createDataFrame(mixed[i : i + 50], FEED))
        assert sorted((str(r.k), r.ts, r.value, r.txn_id, r.seq) for r in t.read().collect()) == want
        again = t.apply(spark.createDataFrame(mixed[:1], FEED))
        assert again["rewritten"] == 1 and t.read().count() == len(want)
        v = t.manifest()["version"]
        assert t.apply(spark.createDataFrame([], FEED))["version"] == v
        assert t.read(version=1) is not None and t.vacuum() >= 1 and t.read().count() == len(want)
    with pytest.raises(ValueError):
        ChangeTable(spark, str(tmp_path / "t0"), ["k", "ts"], ["txn_id", "seq"], buckets=8).apply(spark.createDataFrame(feed[:1], FEED))
