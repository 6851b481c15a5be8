"""Query -> DataFrame. Catalyst does the rest: pushdown, pruning, partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewell.operators.aggregate import aggregate, downsample
from tidewell.operators.rate import rate
from tidewell.operators.resolve import resolve_latest
from tidewell.operators.scan import scan_series
from tidewell.plans.language import Query


def build(samples: DataFrame, q: Query, unique: bool = False, bucket_ms: int | None = None) -> DataFrame:
    """The DataFrame (series_key, ts, value) of a query.

    ``unique`` says that (series_key, ts) is known to be unique, which saves the version resolution.
    ``bucket_ms`` is the width of the ``time_bucket`` partition column, if the table has one.
    """
    df = scan_series(samples, q.series_key, q.start, q.end, bucket_ms)
    df = df.where("NOT coalesce(is_deleted, false)") if unique else resolve_latest(df)
    df = df.select("series_key", "ts", "value")
    if q.downsample > 0:
        return downsample(df, q.downsample, q.function or "AVG")
    if q.function == "RATE":
        return rate(df)
    if q.function:
        return aggregate(df, q.function)
    return df


def describe(q: Query) -> str:
    """A short logical description of a query, outermost operator first."""
    lines = []
    if q.downsample > 0:
        lines.append(f"Downsample interval={q.downsample}ms function={q.function or 'AVG'}")
    elif q.function:
        lines.append(f"Aggregate function={q.function}")
    lines += ["Resolve newest version per (series, ts)", f"Scan series={q.series_key} range=[{q.start}, {q.end}]"]
    return "\n".join("  " * i + x for i, x in enumerate(lines))
