"""Engine facade and JSON interface over a sample store."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.durations import parameter_ms
from tidewell.functions.numbers import general_text
from tidewell.model import WRITE_REQUEST_SCHEMA
from tidewell.operators.scan import list_series
from tidewell.plans.builder import build, describe
from tidewell.plans.language import Query, QueryError, parse
from tidewell.sources.binary import split_key
from tidewell.sources.store import SampleStore


class Engine:
    """Queries and writes; ``clock`` gives milliseconds."""

    def __init__(self, store: SampleStore, clock=lambda: int(time.time() * 1000)):
        self.store, self.spark, self.clock = store, store.spark, clock

    def write_json(self, payload: str, batch_id: str | None = None) -> int:
        """Write one request body; returns the number of samples. ValueError if there are none."""
        rows = flatten_json(self.spark.createDataFrame([(payload,)], "body string"), "body", F.lit(self.clock()))
        rows = rows.cache()
        try:
            if not (n := rows.count()):
                raise ValueError("no samples in the request")
            self.store.write(rows, batch_id)
            return n
        finally:
            rows.unpersist()

    def frame(self, q: Query) -> DataFrame:
        """The lazily planned result of a query."""
        return build(self.store.snapshot(start=q.start, end=q.end), q, bucket_ms=self.store.bucket_ms)

    def query(self, text: str) -> DataFrame:
        return self.frame(parse(text, self.clock()))

    def explain(self, text: str) -> str:
        return describe(parse(text, self.clock()))

    def series(self) -> list[str]:
        return sorted(r[0] for r in list_series(self.store.read()).collect())

    def matrix(self, q: Query) -> dict[str, Any]:
        """The result envelope: one result with [seconds, "value"] pairs in time order."""
        points = self.frame(q).orderBy("ts").select("ts", "value").toLocalIterator()
        name, labels = split_key(q.series_key)
        values = [[ts / 1000.0, general_text(v)] for ts, v in points]
        return {"status": "success", "data": {"resultType": "matrix", "result": [{"metric": {"__name__": name, **labels}, "values": values}]}}


def flatten_json(bodies: DataFrame, column: str, now_ms) -> DataFrame:
    """Samples (metric, labels, ts, value) of write request bodies; timestamp 0 means ``now_ms``. Bad JSON raises."""
    parsed = bodies.select(F.from_json(column, WRITE_REQUEST_SCHEMA, {"mode": "FAILFAST"}).alias("_r"), now_ms.alias("_now"))
    each = parsed.select("_now", F.explode("_r.timeseries").alias("_s"))
    flat = each.select("_now", "_s.metric", "_s.labels", F.explode("_s.samples").alias("_p"))
    ts = F.when(F.coalesce("_p.timestamp", F.lit(0)) == 0, F.col("_now")).otherwise(F.col("_p.timestamp"))
    return flat.select("metric", "labels", ts.alias("ts"), F.col("_p.value").alias("value"))


def respond(engine: Engine, method: str, path: str, params: dict[str, str], body: str = "") -> tuple[int, dict[str, Any] | None]:
    """Status and JSON of one call of the HTTP interface."""

    def error(code: int, text: object) -> tuple[int, dict[str, Any]]:
        return code, {"status": "error", "error": str(text)}

    match method, path:
        case "POST", "/api/v1/write":
            try:
                json.loads(body)
                engine.write_json(body)
            except ValueError as e:
                return error(400, e)
            except Exception as e:  # noqa: BLE001
                return error(500, e)
            return 204, None
        case "GET", "/api/v1/query" | "/api/v1/query_range":
            if not params.get("query"):
                return error(400, "missing query parameter")
            try:
                q = parse(params["query"], engine.clock())
            except QueryError as e:
                return error(400, e)
            if path.endswith("range"):
                q = override_range(q, params)
            try:
                return 200, engine.matrix(q)
            except Exception as e:  # noqa: BLE001
                return error(500, e)
        case "GET", "/api/v1/series":
            return 200, {"status": "success", "data": engine.series()}
        case "GET", "/api/v1/status":
            return 200, {"status": "success", "data": engine.store.status()}
        case "GET", "/health":
            return 200, {"status": "ok"}
    return error(404, "no such path")


def override_range(q: Query, params: dict[str, str]) -> Query:
    """``start`` and ``end`` replace the query's own where they can be read; ``step`` is accepted and ignored."""
    ends = {}
    for k in ("start", "end"):
        try:
            ends[k] = parameter_ms(params[k])
        except (KeyError, ValueError):
            continue
    return Query(q.metric, q.labels, ends.get("start", q.start), ends.get("end", q.end), q.downsample, q.function)


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8080):
    """A small HTTP server over ``respond``; returns it unstarted."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qsl, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def _go(self) -> None:
            url = urlsplit(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            code, content = respond(engine, self.command, url.path, dict(parse_qsl(url.query)), body)
            raw = b"" if content is None else json.dumps(content).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _go  # noqa: N815

        def log_message(self, *args) -> None:
            """Quiet."""

    return ThreadingHTTPServer((host, port), Handler)
