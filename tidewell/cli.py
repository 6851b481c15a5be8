"""Command line: ``python -m tidewell.cli STORE (write FILE | query TEXT | status | maintain | serve)``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tidewell.api import Engine, respond, serve
from tidewell.sources.store import SampleStore


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewell")
    p.add_argument("store")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("write").add_argument("file")
    sub.add_parser("query").add_argument("text")
    sub.add_parser("status")
    sub.add_parser("maintain").add_argument("--strategy", default="time_window")
    sub.add_parser("serve").add_argument("--port", type=int, default=8080)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tidewell").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(SampleStore(spark, a.store))
    match a.command:
        case "write":
            with open(a.file) as f:
                code, out = respond(engine, "POST", "/api/v1/write", {}, f.read())
        case "query":
            code, out = respond(engine, "GET", "/api/v1/query", {"query": a.text})
        case "maintain":
            code, out = 200, engine.store.maintain(engine.clock(), a.strategy)
        case "serve":
            serve(engine, port=a.port).serve_forever()
            return 0
        case _:
            code, out = respond(engine, "GET", "/api/v1/status", {})
    if out is not None:
        print(json.dumps(out))
    return int(code >= 400)


if __name__ == "__main__":
    sys.exit(main())
