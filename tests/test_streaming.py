import json

from tidewell.sources.changetable import ChangeTable
from tidewell.sources.store import SampleStore
from tidewell.streaming.ingest import apply_changes, ingest_requests
from tidewell.streaming.periods import Periods, stream_periods


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = {"timeseries": [{"metric": "cpu", "samples": [{"timestamp": 1, "value": 2.0}]}]}
    (tmp_path / "in" / "a.txt").write_text(json.dumps(body))
    store = SampleStore(spark, str(tmp_path / "s"))
    stream = spark.readStream.text(str(tmp_path / "in"))
    for _ in range(2):
        ingest_requests(stream, store, str(tmp_path / "c")).awaitTermination(60)
    assert [(r.series_key, r.value) for r in store.read().collect()] == [("cpu", 2.0)] and len(store.versions()) == 1


def test_change_stream(spark, tmp_path):
    schema = "metric string, labels map<string,string>, ts bigint, value double, txn_id bigint, seq int, is_deleted boolean"
    spark.createDataFrame([("m", None, 1, 1.0, 1, 0, False), ("m", None, 1, 2.0, 3, 0, False), ("m", None, 2, 2.0, 2, 0, True)], schema).write.parquet(str(tmp_path / "in"))
    t = ChangeTable(spark, str(tmp_path / "t"), ["series_key", "ts"], ["txn_id", "seq"], 2)
    apply_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), t, str(tmp_path / "c")).awaitTermination(60)
    assert [(r.ts, r.value) for r in t.read().collect()] == [(1, 2.0)]


def test_periods_wait_for_every_source_but_not_for_idle_ones():
    p = Periods(100, 10, 1000)
    p.add([("a", 5, 1.0), ("b", 7, 2.0)], 0)
    out = p.add([("a", 250, 1.0)], 10)  # b holds the period open
    assert all(not r[5] for r in out)
    p = Periods(100, 10, 1000, p.state())
    assert (0, 3, 6.0, 1.0, 3.0, False, None, None) in p.add([("b", 50, 3.0)], 20)
    out = p.add([("b", 120, None)], 30)  # a punctuation moves b past the first period
    assert out == [(0, 3, 6.0, 1.0, 3.0, True, None, None)]
    assert p.add([("b", 60, 9.0)], 40) == [(0, None, None, None, None, True, 60, 9.0)]
    p.add([("a", 900, 1.0)], 2000)  # b has been silent for too long
    assert p.closed_to == 890


def test_stream_periods(spark, tmp_path):
    schema = "grp string, source string, ts bigint, value double"
    spark.createDataFrame([("g", "a", 5, 1.0), ("g", "a", 500, 2.0), ("g", "a", 6, 4.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    df = stream_periods(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 100, 0)
    q = df.writeStream.format("memory").queryName("periods").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {(r.period_start, r.closed, r.late_ts): r.n_values for r in spark.table("periods").collect()}
    assert got[(0, True, None)] == 1 and (0, True, 6) in got and got[(500, False, None)] == 1
