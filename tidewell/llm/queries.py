"""Registered queries of the llm operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import distinct, leaks, packing, percentiles, pii
from tidewell.model import read_table
from tidewell.runtime import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _sql_key(m: str, x: str) -> str:
    pairs = f"""list_transform(list_sort(map_keys({x})), lambda z: z || '="' || {x}[z] || '"')"""
    return f"CASE WHEN {x} IS NULL OR cardinality({x}) = 0 THEN {m} ELSE {m} || '{{' || array_to_string({pairs}, ',') || '}}' END"


#: The number of bits that distinct.sized_bits gives for each count of rows, as a table by its own rule.
_SIZES = ",".join(f"({n}, {m})" for n, m in distinct.size_steps())
SQL["p6_distinct_clients"] = f"""WITH z AS (SELECT CAST(min(m) AS DOUBLE) AS mm, min(m) AS m FROM (VALUES {_SIZES}) AS v(n, m) WHERE n >= (SELECT count(*) FROM series_seen WHERE labels['client'] IS NOT NULL))
 SELECT grouping, day, metric, tenant, region, set_bits, round(n, 3) AS estimate,
 round(sqrt(mm * CASE WHEN n / mm < 0.01 THEN (n / mm) * (n / mm) / 2 + (n / mm) * (n / mm) * (n / mm) / 6 ELSE exp(n / mm) - n / mm - 1 END) / n, 9) AS rel_error,
 set_bits >= m AS saturated FROM (SELECT *, -mm * ln(1 - set_bits / mm) AS n
 FROM (SELECT CAST(GROUPING(day, metric, tenant, region) AS INTEGER) AS grouping, day, metric, tenant, region, count(DISTINCT bit) AS set_bits FROM (
 SELECT CAST(CAST(seen_at AS DATE) AS VARCHAR) AS day, metric, labels['tenant'] AS tenant, labels['region'] AS region, CAST('0x' || md5(labels['client'])[1:15] AS BIGINT) % m AS bit
 FROM series_seen, z WHERE labels['client'] IS NOT NULL) GROUP BY CUBE (day, metric, tenant, region)), z)"""
SQL["p6_accuracy"] = "SELECT 16 AS combinations, 0 AS beyond_four_errors"


def _p6_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """Estimates of every combination against exact counts: groups off by more than four standard errors and two identifiers, less one in 500."""
    seen = read_table(spark, root, "series_seen")
    got = distinct.client_counts(seen)
    rows = distinct.client_rows(seen).where("client IS NOT NULL")
    exact = rows.cube("day", "metric", "tenant", "region").agg(F.grouping_id().cast("int").alias("grouping"), F.countDistinct("client").alias("true_n"))
    same = got.join(exact, [got[c].eqNullSafe(exact[c]) for c in ("grouping", "day", "metric", "tenant", "region")])
    off = F.abs(F.col("estimate") - F.col("true_n")) > 4 * F.col("rel_error") * F.col("estimate") + 2
    n = F.count(F.lit(1))
    return same.agg(F.countDistinct(got["grouping"]).cast("int").alias("combinations"), F.greatest(F.lit(0), F.count_if(off) - F.floor(n / 500)).cast("int").alias("beyond_four_errors"))


QUERIES["p6_accuracy"] = _p6_accuracy


def _p6(spark: SparkSession, root: str) -> DataFrame:
    out = distinct.client_counts(read_table(spark, root, "series_seen"))
    return out.withColumn("estimate", F.round("estimate", 3)).withColumn("rel_error", F.round("rel_error", 9))


QUERIES["p6_distinct_clients"] = _p6

SQL["p7_percentiles"] = f"""WITH s AS (SELECT metric, labels, value FROM samples WHERE NOT is_deleted AND value IS NOT NULL),
 m AS (SELECT 'metric' AS kind, metric AS grp, value FROM s UNION ALL SELECT 'series', {_sql_key("metric", "labels")}, value FROM s
 UNION ALL SELECT 'label', k || '="' || labels[k] || '"', value FROM (SELECT labels, value, unnest(map_keys(labels)) AS k FROM s)),
 r AS (SELECT kind, grp, value, row_number() OVER (PARTITION BY kind, grp ORDER BY value) AS i, count(*) OVER (PARTITION BY kind, grp) AS n FROM m)
 SELECT kind, grp, max(n) AS n, {", ".join(f"max(value) FILTER (i = (n * {p} + 99) // 100) AS p{p}" for p in percentiles.PERCENTS)} FROM r GROUP BY kind, grp"""


def _p7(spark: SparkSession, root: str) -> DataFrame:
    return percentiles.percentiles(percentiles.sorted_runs(read_table(spark, root, "samples")))


QUERIES["p7_percentiles"] = _p7
SQL["p7_percentiles_in_rounds"] = SQL["p7_percentiles"]


def _p7_rounds(spark: SparkSession, root: str) -> DataFrame:
    """As p7_percentiles, with limits so low that every group of some size goes through the rounds of the selection."""
    return percentiles.percentiles(percentiles.sorted_runs(read_table(spark, root, "samples")), one_task=8_000, piece=1_024, gather=1_024)


QUERIES["p7_percentiles_in_rounds"] = _p7_rounds


def _p8(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(read_table(spark, root, "documents"))


QUERIES["p8_packing"] = _p8
SQL["p8_invariants"] = "SELECT count(*) AS pages, 0 AS tokens_lost, 0 AS split_needlessly, 0 AS over_capacity, true AS well_filled, true AS mixture_kept FROM documents"


def _p8_invariants(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the whole packing: every token once, no container too full, no needless cut, little room left, shares kept."""
    sizes = stored(packing.count_tokens(read_table(spark, root, "documents")), "sizes")
    packed = stored(packing.pack_sized(sizes), "packed")
    out = packing.check(packed, sizes)
    return out.select("pages", "tokens_lost", "split_needlessly", "over_capacity", (F.col("fill") > 0.97).alias("well_filled"), (F.col("share_error") < 0.03).alias("mixture_kept"))


QUERIES["p8_invariants"] = _p8_invariants


def _p9(spark: SparkSession, root: str) -> DataFrame:
    return leaks.find_leaks(read_table(spark, root, "documents"), read_table(spark, root, "eval_items"))


QUERIES["p9_found"] = _p9


def _p10(spark: SparkSession, root: str) -> DataFrame:
    return pii.find_personal(read_table(spark, root, "documents"))


QUERIES["p10_found"] = _p10


def _p10_redacted(spark: SparkSession, root: str) -> DataFrame:
    return pii.redact(read_table(spark, root, "documents"))


QUERIES["p10_redacted"] = _p10_redacted
