"""Exact percentiles of very large groups by distributed multi-select.

Each input partition turns its rows into sorted runs per series: the mergeable partial result (``sorted_runs``), which
may be stored per day or file and combined later. Groups (a metric, a series, a label value) are unions of runs. A group
small enough is selected from its runs in one task. A larger one is spread over pieces, each a sorted array, and its
ranks are found in rounds: pieces propose the median of what is left of them, the weighted median of the proposals
becomes the pivot, the pieces count below, equal and above, the side that cannot hold the rank is discarded; what is
left, once small, is gathered. All ranks of all groups advance in the same rounds. The result is exact, and a round
moves a few numbers per piece, never the values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.model import series_hash, series_key
from tidewell.runtime import join_small, shuffle_width, stored

PERCENTS = (50, 90, 95, 99)
#: Values of a group that one task selects from; larger groups go through rounds.
ONE_TASK = 100_000
#: Values per piece of a larger group, and values left of a rank at which they are gathered.
PIECE = 65_536
GATHER = 16_384
#: Pieces whose medians are merged at a time.
CHUNK = 512
_RUN = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("n", pa.int64()), ("run", pa.binary())])


def _cut_runs(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, value) -> sorted runs per series, at most ``most`` rows at a time."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        h1, h2, v = (t[c].combine_chunks().to_numpy() for c in ("h1", "h2", "value"))
        order = np.lexsort((v, h2, h1))
        h1, h2, v = h1[order], h2[order], v[order]
        edge = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
        ends = np.append(edge[1:], len(v))
        raw = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer((np.append(edge, len(v)) * 8).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(v, dtype="<f8").tobytes())])
        return pa.record_batch([h1[edge], h2[edge], ends - edge, raw], schema=_RUN)

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= most:
            yield flush(held)
            held, n = [], 0
    if held:
        yield flush(held)


def sorted_runs(samples: DataFrame) -> DataFrame:
    """Mergeable partial result: (series_key, metric, labels, n, run) with ``run`` the sorted values as 8-byte floats.

    Counted are rows with ``is_deleted`` not true and a value that is neither NULL nor NaN. Results of separate days
    or files combine by union.
    """
    h1, h2 = series_hash()
    rows = samples.where("NOT coalesce(is_deleted, false) AND value IS NOT NULL AND NOT isnan(value)").select(h1.alias("h1"), h2.alias("h2"), "value", "metric", "labels")
    runs = rows.select("h1", "h2", "value").mapInArrow(_cut_runs, "h1 bigint, h2 int, n bigint, run binary")
    names = rows.groupBy("h1", "h2").agg(F.first("metric").alias("metric"), F.first("labels").alias("labels"))
    return runs.join(names, ["h1", "h2"]).select(series_key().alias("series_key"), "metric", "labels", "n", "run")


def _memberships(runs: DataFrame) -> DataFrame:
    """(kind, grp, n, run): every run once for its metric, its series and each of its labels."""
    pairs = F.transform(F.map_entries(F.coalesce("labels", F.expr("map()").cast("map<string,string>"))), lambda e: F.struct(F.lit("label").alias("kind"), F.concat(e["key"], F.lit('="'), F.coalesce(e["value"], F.lit("")), F.lit('"')).alias("grp")))
    whole = F.array(F.struct(F.lit("metric").alias("kind"), F.coalesce("metric", F.lit("")).alias("grp")), F.struct(F.lit("series").alias("kind"), F.coalesce("series_key", F.lit("")).alias("grp")))
    return runs.select("n", "no", "run", F.explode(F.concat(whole, pairs)).alias("_g")).select("_g.kind", "_g.grp", "n", "no", "run")


def rank_of(percent: int, n: int) -> int:
    """0-based nearest rank of a percentile among n values."""
    return max(-(-n * percent // 100), 1) - 1


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Runs of each group of batches sorted by ``keys``."""
    now, held = None, []
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in keys]
        run = b.column(b.schema.get_field_index("run"))
        for i, key in enumerate(zip(*cols, strict=True)):
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(np.frombuffer(run[i].as_py(), dtype="<f8"))
    if held:
        yield now, held


def _select_whole(percents: tuple[int, ...]):
    names = ["kind", "grp", "n", *[f"p{p}" for p in percents]]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, held in _groups(batches, ["kind", "grp"]):
            v = np.concatenate(held)
            ranks = [rank_of(p, len(v)) for p in percents]
            part = np.partition(v, sorted(set(ranks)))
            out.append((*key, len(v), *[float(part[k]) for k in ranks]))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out])
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out])

    return go


def _merge_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (kind, grp, piece), held in _groups(batches, ["kind", "grp", "piece"]):
        v = np.sort(np.concatenate(held))
        yield pa.record_batch([pa.array([kind]), pa.array([grp]), pa.array([piece], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["kind", "grp", "piece", "run"])


_COUNTED = "kind string, grp string, piece int, q int, lo double, hi double, k bigint, pivot double, n_lt bigint, n_eq bigint, n_gt bigint, med_lt double, med_gt double"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece and a state -> counts around the pivot, and the medians of what lies on either side."""
    for b in batches:
        rows = b.to_pylist()
        out = []
        for r in rows:
            v = np.frombuffer(r["run"], dtype="<f8")
            a, z = np.searchsorted(v, r["lo"], "right") if r["lo"] is not None else 0, np.searchsorted(v, r["hi"], "left") if r["hi"] is not None else len(v)
            z = max(a, z)
            p = r["pivot"]
            if p is None:
                lt, le = a, a
                med_lt, med_gt = None, float(v[(a + z - 1) // 2]) if z > a else None
            else:
                lt, le = np.searchsorted(v, p, "left"), np.searchsorted(v, p, "right")
                med_lt = float(v[(a + lt - 1) // 2]) if lt > a else None
                med_gt = float(v[(le + z - 1) // 2]) if z > le else None
            out.append({k: r[k] for k in ("kind", "grp", "piece", "q", "lo", "hi", "k", "pivot")} | {"n_lt": int(lt - a), "n_eq": int(le - lt), "n_gt": int(z - le), "med_lt": med_lt, "med_gt": med_gt})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


_SCHEMA = pa.schema([("kind", pa.string()), ("grp", pa.string()), ("piece", pa.int32()), ("q", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("k", pa.int64()), ("pivot", pa.float64()), ("n_lt", pa.int64()), ("n_eq", pa.int64()), ("n_gt", pa.int64()), ("med_lt", pa.float64()), ("med_gt", pa.float64())])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece and a state -> the values still possible."""
    for b in batches:
        for r in b.to_pylist():
            v = np.frombuffer(r["run"], dtype="<f8")
            a = np.searchsorted(v, r["lo"], "right") if r["lo"] is not None else 0
            z = np.searchsorted(v, r["hi"], "left") if r["hi"] is not None else len(v)
            if z > a:
                yield pa.record_batch([pa.array([r["kind"]]), pa.array([r["grp"]]), pa.array([r["q"]], pa.int32()), pa.array([r["k"]], pa.int64()), pa.array([v[a:z].tobytes()], pa.binary())], names=["kind", "grp", "q", "k", "run"])


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (kind, grp, q, k), held in _groups(batches, ["kind", "grp", "q", "k"]):
        v = np.partition(np.concatenate(held), k)
        yield pa.record_batch([pa.array([kind]), pa.array([grp]), pa.array([q], pa.int32()), pa.array([float(v[k])])], names=["kind", "grp", "q", "value"])


def _multi_select(hot: DataFrame, totals: DataFrame, percents: tuple[int, ...], width: int, piece: int, gather: int) -> DataFrame:
    """(kind, grp, q, value) of the large groups; ``totals`` has (kind, grp, total)."""
    pieces_of = F.expr(f"cast((total + {piece - 1}) div {piece} as int)")
    # runs go to pieces by their number and content, so equal runs do not meet in one piece
    routed = hot.withColumn("piece", F.pmod(F.xxhash64("no", "run"), pieces_of).cast("int"))
    pieces = (
        routed.repartition(width, "kind", "grp", "piece")
        .sortWithinPartitions("kind", "grp", "piece")
        .select("kind", "grp", "piece", "run")
        .mapInArrow(_merge_pieces, "kind string, grp string, piece int, run binary")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    ranks = F.array(*[F.struct(F.lit(p).cast("int").alias("q"), (F.expr(f"(total * {p} + 99) div 100") - 1).alias("k")) for p in percents])
    none = F.lit(None).cast("double")
    state = totals.select("kind", "grp", F.explode(ranks).alias("_r"), "total").select(
        "kind", "grp", "_r.q", "_r.k", none.alias("lo"), none.alias("hi"), none.alias("pivot"), F.col("total").alias("n_left"), none.alias("value")
    )
    state = stored(state, "select")
    key = ["kind", "grp", "q"]
    for _ in range(64):
        active = state.where(f"value IS NULL AND n_left > {gather}")
        if active.isEmpty():
            break
        # a state is a row per large group and rank; it goes to the pieces by broadcast while it is small
        asked = join_small(pieces, active.drop("value", "n_left"), ["kind", "grp"])
        counted = stored(asked.select("kind", "grp", "piece", "q", "lo", "hi", "k", "pivot", "run").mapInArrow(_count, _COUNTED), "counts")
        # counts are sums, combined on the map side
        sums = counted.groupBy(*key).agg(F.sum("n_lt").alias("_lt"), F.sum("n_eq").alias("_eq"), F.sum("n_gt").alias("_gt"))
        side = F.when(F.col("k") < F.col("_lt"), -1).when(F.col("k") < F.col("_lt") + F.col("_eq"), 0).otherwise(1)
        moved = active.drop("value", "n_left").join(sums, key).withColumn("_go", side)
        # weighted medians in two steps: of some hundred pieces each, then of those medians; no task gets all pieces of a group
        weight = F.when(F.col("_go") < 0, F.col("n_lt")).when(F.col("_go") > 0, F.col("n_gt")).otherwise(0)
        median = F.when(F.col("_go") < 0, F.col("med_lt")).when(F.col("_go") > 0, F.col("med_gt"))
        votes = join_small(counted.select(*key, "piece", "n_lt", "n_gt", "med_lt", "med_gt"), moved.select(*key, "_go"), key)
        votes = votes.select(*key, F.expr(f"piece div {CHUNK}").alias("chunk"), weight.alias("w"), median.alias("m")).where("w > 0")
        pivots = _weighted_median(_weighted_median(votes, [*key, "chunk"]), key)
        down, up = F.col("_go") < 0, F.col("_go") > 0
        new = moved.join(pivots.select(*key, F.col("m").alias("_m")), key, "left").select(
            *key,
            F.when(up, F.col("k") - F.col("_lt") - F.col("_eq")).otherwise(F.col("k")).alias("k"),
            F.when(up, F.coalesce("pivot", "lo")).otherwise(F.col("lo")).alias("lo"),
            F.when(down, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.col("_m").alias("pivot"),
            F.when(down, F.col("_lt")).when(up, F.col("_gt")).otherwise(0).alias("n_left"),
            F.when(F.col("_go") == 0, F.col("pivot")).alias("value"),
        )
        state = stored(state.where(f"value IS NOT NULL OR n_left <= {gather}").unionByName(new), "select")
    else:
        raise RuntimeError("selection did not end")
    rest = state.where("value IS NULL").select(*key, "k", "lo", "hi")
    gathered = (
        join_small(pieces, rest, ["kind", "grp"])
        .select("kind", "grp", "q", "k", "lo", "hi", "run")
        .mapInArrow(_left, "kind string, grp string, q int, k bigint, run binary")
        .repartition(width, *key)
        .sortWithinPartitions(*key, "k")
        .mapInArrow(_pick, "kind string, grp string, q int, value double")
    )
    out = stored(gathered.unionByName(state.where("value IS NOT NULL").select("kind", "grp", "q", "value")), "selected")
    pieces.unpersist()
    return out


def _weighted_median(votes: DataFrame, by: list[str]) -> DataFrame:
    """Per group of (w, m) the lower weighted median of m and the sum of the weights; ``chunk`` drops out of what comes after."""
    order = W.partitionBy(*by).orderBy("m").rowsBetween(W.unboundedPreceding, 0)
    ranked = votes.withColumn("_cum", F.sum("w").over(order)).withColumn("_tot", F.sum("w").over(W.partitionBy(*by)))
    return ranked.groupBy(*by).agg(F.max("_tot").alias("w"), F.min(F.when(F.col("_cum") * 2 >= F.col("_tot"), F.col("m"))).alias("m"))


def percentiles(runs: DataFrame, percents: tuple[int, ...] = PERCENTS, one_task: int | None = None, piece: int | None = None, gather: int | None = None) -> DataFrame:
    """One row per group: kind (metric, series, label), grp, n, p50, p90, ... by nearest rank, exact.

    ``runs`` are sorted runs of any number of parts. A NULL metric is the group "". Groups without values do not
    appear; an empty input gives no rows. Groups above ``one_task`` values go through rounds, in pieces of about ``piece``, until
    ``gather`` values are left of a rank; the result is the same for any limits.
    """
    one_task, piece, gather = (d if x is None else x for x, d in ((one_task, ONE_TASK), (piece, PIECE), (gather, GATHER)))
    width = shuffle_width(runs.sparkSession)
    kept = stored(runs.withColumn("no", F.monotonically_increasing_id()), "runs")
    members = _memberships(kept)
    totals = stored(members.groupBy("kind", "grp").agg(F.sum("n").alias("total")), "totals")
    large = totals.where(F.col("total") > one_task)
    names = ", ".join(f"p{p} double" for p in percents)
    sized = members.join(totals, ["kind", "grp"])
    cold = (
        sized.where(F.col("total") <= one_task)
        .select("kind", "grp", "run")
        .repartition(width, "kind", "grp")
        .sortWithinPartitions("kind", "grp")
        .mapInArrow(_select_whole(percents), f"kind string, grp string, n bigint, {names}")
    )
    if large.isEmpty():
        return cold
    found = _multi_select(sized.where(F.col("total") > one_task), large, percents, width, piece, gather)
    wide = found.groupBy("kind", "grp").agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(f"p{p}") for p in percents])
    hot = large.join(wide, ["kind", "grp"]).select("kind", "grp", F.col("total").alias("n"), *[f"p{p}" for p in percents])
    return cold.unionByName(hot)
