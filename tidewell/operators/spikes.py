"""Faulty readings per series: spikes, frozen stretches and values that the quantity cannot take.

A local-level state-space model is filtered per series (a Kalman filter; counters carry their usual step as drift).
A reading whose standardised innovation passes the gate is flagged and its update withheld. A run of flagged
readings that agree with each other for ``SHIFT_RUN`` readings is a lasting change of level (or a restart): the state
moves there and the run is no fault. Where the variance of the innovations vanishes over ten readings in a series that otherwise
moves, the stretch is frozen; a run of (almost) equal readings there gives its exact ends.

Scale: a series' readings are cut into shards of ``SHARD_ROWS`` rows by their place in the series, known from row counts per
(series, ten minutes) and numbers inside; neighbouring shards exchange ``HALO_ROWS`` readings, with which the filter settles and runs
across a boundary are completed. No task holds more than a shard of a series. A task filters its shards side by side:
one numpy step advances all of them.

The gate's width is the series' own noise; how wide its usual bursts reach is taken from the histogram of all its
innovations, merged over its shards, or from the metric's where a series has few readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.model import series_hash
from tidewell.runtime import join_small, shuffle_width, stored

SHARD_ROWS = 2048
HALO_ROWS = 96
BUCKET_MS = 600_000
#: Readings that must agree before a change of level is taken as lasting.
SHIFT_RUN = 7
#: Equal readings that make a frozen stretch.
FROZEN_RUN = 10
#: Gate of the filter and least gate of the report in standard deviations, and the share of readings whose innovations count as usual.
GATE = 6.0
REPORT_GATE = 6.5
USUAL_SHARE = 0.985
USUAL_MARGIN = 1.4
#: Readings from which on a series' own innovations say what is usual.
OWN_GATE_ROWS = 1000
#: What a unit can measure by its definition. Units not named are unbounded; ``min_value`` and ``max_value`` of
#: metric_info, where it has such columns, take precedence.
UNIT_BOUNDS = {
    "percent": (0.0, 100.0),
    "ratio": (0.0, 1.0),
    "celsius": (-273.15, 1e4),
    "seconds": (0.0, None),
    "ms": (0.0, None),
    "bytes": (0.0, None),
    "rows": (0.0, None),
    "requests": (0.0, None),
    "operations": (0.0, None),
    "messages": (0.0, None),
    "threads": (0.0, None),
    "rpm": (0.0, None),
    "volt": (0.0, None),
}
_BINS = 80


def _readings(samples: DataFrame, metric_info: DataFrame) -> DataFrame:
    """Live readings with hashes of the series, a metric number, its kind and its bounds."""
    own = {c: F.max(c).cast("double") if c in metric_info.columns else F.lit(None).cast("double") for c in ("min_value", "max_value")}
    info = metric_info.where("metric IS NOT NULL").groupBy("metric").agg(F.max("kind").alias("_kind"), F.max("unit").alias("_unit"), own["min_value"].alias("_min"), own["max_value"].alias("_max"))
    h1, h2 = series_hash()
    rows = samples.where("NOT coalesce(is_deleted, false) AND ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    low = F.lit(None).cast("double")
    high = F.lit(None).cast("double")
    for unit, (a, b) in UNIT_BOUNDS.items():
        low = F.when(F.col("_unit") == unit, F.lit(a)).otherwise(low)
        high = F.when(F.col("_unit") == unit, F.lit(b)).otherwise(high)
    info = info.select("metric", (F.coalesce("_kind", F.lit("gauge")) == "counter").alias("_counter"), F.coalesce("_min", low).alias("_low"), F.coalesce("_max", high).alias("_high"))
    slim = rows.select("sample_id", "metric", "ts", "value", h1.alias("h1"), h2.alias("h2"))
    return join_small(slim, info, "metric", "left").select(
        "sample_id",
        "ts",
        "value",
        "h1",
        "h2",
        F.xxhash64("metric").alias("m"),
        F.coalesce("_counter", F.lit(False)).alias("counter"),
        (F.coalesce(F.col("value") < F.col("_low"), F.lit(False)) | F.coalesce(F.col("value") > F.col("_high"), F.lit(False))).alias("impossible"),
    )


def _profile(rows: DataFrame) -> DataFrame:
    """Per metric whether its readings are positive and skewed, so that they are judged by their logarithm.

    Skew is the ratio of the upper to the lower spread around the median, per series, and the median of that over
    the metric's series. All rows take part; the states are mergeable sketches.
    """
    per_series = (
        rows.where("NOT counter AND NOT impossible")
        .groupBy("m", "h1", "h2")
        .agg(F.percentile_approx("value", [0.1, 0.5, 0.9], 500).alias("q"), F.avg((F.col("value") > 0).cast("double")).alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    up, down = F.col("q")[2] - F.col("q")[1], F.col("q")[1] - F.col("q")[0]
    skew = F.when(down > 0, up / down)
    return (
        per_series.where("n >= 20")
        .groupBy("m")
        .agg(F.percentile_approx(skew, 0.5, 1000).alias("skew"), F.avg("pos").alias("pos"))
        .select("m", F.coalesce((F.col("skew") > 1.5) & (F.col("pos") > 0.97), F.lit(False)).alias("skewed"))
    )


def _shards(rows: DataFrame, shard_rows: int, halo_rows: int) -> DataFrame:
    """Rows with ``shard``, ``core`` and ``many`` (series of several shards); rows near a boundary appear once more in the shard whose halo they are.

    Row counts per (series, bucket) are summed along the series, and rows are numbered inside their bucket, so every row's
    place in its series is known without ordering the series in one task. A row goes to the shard its place falls in,
    and to a neighbour only if it lies within ``halo_rows`` rows of it, however many rows a bucket has.
    """
    rows = rows.withColumn("bucket", F.expr(f"ts div {BUCKET_MS}L"))
    key = ["h1", "h2", "bucket"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy("h1", "h2").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    at = counts.select(*key, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("c"), F.sum("n").over(W.partitionBy("h1", "h2")).alias("all"))
    # only series of more than one shard are cut
    cut = at.where(F.col("all") > shard_rows).select(*key, "c")
    # the order is total, so that a task that runs again numbers its rows alike; join and numbering share one exchange
    inside = F.row_number().over(W.partitionBy(*key).orderBy("ts", "value", "sample_id"))
    wide = rows.join(cut.hint("merge"), key, "left").withColumn("_at", F.col("c") + inside - 1).drop("bucket", "c").withColumn("many", F.col("_at").isNotNull())
    own = F.expr(f"coalesce(_at, 0L) div {shard_rows}L")
    of = F.expr(f"sequence(greatest(coalesce(_at, 0L) - {halo_rows}L, 0L) div {shard_rows}L, (coalesce(_at, -{halo_rows}L) + {halo_rows}L) div {shard_rows}L)")
    return wide.withColumn("_own", own).withColumn("shard", F.explode(of)).withColumn("core", F.col("shard") == F.col("_own")).drop("_at", "_own")


# --- numpy: many shards side by side -----------------------------------------------------------------------------------


def _group_median(x: np.ndarray, g: np.ndarray, k: int, default: float = 0.0) -> np.ndarray:
    """Lower median of x per group number g in 0..k-1."""
    out = np.full(k, default)
    if len(x):
        order = np.lexsort((x, g))
        n = np.bincount(g, minlength=k)
        start = np.concatenate(([0], np.cumsum(n)[:-1]))
        has = n > 0
        out[has] = x[order][(start + (n - 1) // 2)[has]]
    return out


def _spread(d: np.ndarray, g: np.ndarray, k: int, centre: np.ndarray) -> np.ndarray:
    """Robust standard deviation of d per group; where more than half are equal, from the mean of the clipped rest."""
    dev = np.abs(d - centre[g])
    mad = 1.4826 * _group_median(dev, g, k)
    n = np.maximum(np.bincount(g, minlength=k), 1)
    moving = np.bincount(g, weights=dev > 0, minlength=k) / n
    nonzero = dev > 0
    typical = _group_median(dev[nonzero], g[nonzero], k)
    clipped = np.minimum(dev, 3 * typical[g])
    alt = 1.2533 * np.bincount(g, weights=clipped, minlength=k) / n
    return np.where((mad == 0) & (moving > 0.05), alt, mad)


def _filter(y: np.ndarray, skip: np.ndarray, n: np.ndarray, start: np.ndarray, drift: np.ndarray, q: np.ndarray, r: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kalman filter of all shards at once; returns standardised innovations and the number of the shift run (0: none).

    Shards are ordered by length, so the ones still running are a prefix. A flagged reading does not update the
    state; it starts or extends a rival level. SHIFT_RUN agreeing readings move the state to the rival.
    """
    z, run = np.zeros(len(y)), np.zeros(len(y), dtype=np.int64)
    accepted = [np.zeros(0, dtype=np.int64)]
    order = np.argsort(-n, kind="stable")
    n, start, drift, q, r = n[order], start[order], drift[order], q[order], r[order]
    k = len(n)
    m, p = first[order].copy(), r + 4 * q
    rival, agree, rid = np.zeros(k), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
    fresh = 1
    top = int(n[0]) if k else 0
    live = np.searchsorted(-n, -np.arange(top), side="left")  # shards longer than t
    for t in range(top):
        a = live[t]
        i = start[:a] + t
        obs, use = y[i], ~skip[i]
        pred = m[:a] + drift[:a]
        var = p[:a] + q[:a]
        s = var + r[:a]
        dev = obs - pred
        e = dev / np.sqrt(s)
        z[i] = np.where(use, e, 0.0)
        fine = np.abs(e) <= GATE
        gain = np.where(use & fine, var / s, 0.0)
        m[:a] = pred + gain * dev
        # the state waits while updates are withheld: a widening gate would let the rest of a spike in
        p[:a] = np.where(use & fine, var * (1 - gain), p[:a])
        off = use & ~fine
        if off.any():
            j = np.flatnonzero(off)
            near = (agree[j] > 0) & (np.abs(obs[j] - rival[j] - drift[j]) <= GATE * np.sqrt(2 * (r[j] + q[j])))
            new = ~near
            ids = np.arange(fresh, fresh + int(new.sum()))
            fresh += len(ids)
            rid[j[new]] = ids
            agree[j] = np.where(near, agree[j] + 1, 1)
            rival[j] = np.where(near, rival[j] + drift[j] + (obs[j] - rival[j] - drift[j]) / np.maximum(1, np.where(drift[j] != 0, 1, agree[j])), obs[j])
            run[i[j]] = rid[j]
            moved = j[agree[j] >= SHIFT_RUN]
            if len(moved):
                accepted.append(rid[moved])
                m[moved], p[moved] = rival[moved], r[moved] + q[moved]
                agree[moved] = 0
        back = use & fine
        agree[:a][back] = 0
    is_shift = np.zeros(fresh, dtype=bool)
    is_shift[np.concatenate(accepted)] = True
    return z, np.where(is_shift[run], run, 0)


class _Distinct:
    """Readings sorted by (g, ts), of which equal (ts, value) of a shard are one, with the shards' noise.

    ``g`` numbers the shards from 0.
    """

    def __init__(self, g: np.ndarray, ts: np.ndarray, v: np.ndarray, counter: np.ndarray, skewed: np.ndarray, impossible: np.ndarray):
        order = np.lexsort((v, ts, g))
        same = np.zeros(len(v), dtype=bool)
        o1, o0 = order[1:], order[:-1]
        same[1:] = (g[o1] == g[o0]) & (ts[o1] == ts[o0]) & (v[o1] == v[o0])
        self.u = u = order[~same]  # one row of each distinct reading
        self.back = np.empty(len(v), dtype=np.int64)
        self.back[order] = np.cumsum(~same) - 1
        self.ug, self.uv, self.uts, self.ok = g[u], v[u], ts[u], ~impossible[u]
        self.k = int(self.ug[-1]) + 1 if len(u) else 0
        self.n = np.bincount(self.ug, minlength=self.k)
        self.start = np.concatenate(([0], np.cumsum(self.n)[:-1])).astype(np.int64)
        self.kind, self.log = counter[u][self.start], skewed[u][self.start]
        self.med = _group_median(self.uv[self.ok], self.ug[self.ok], self.k)
        with np.errstate(all="ignore"):
            self.y = np.where(self.log[self.ug], np.log(np.maximum(self.uv, 0) + 0.02 * np.abs(self.med[self.ug]) + 1e-300), self.uv)

    def noise(self, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Drift of counters and the spread of steps to the next and the next but two usable reading, per shard."""
        fit = np.flatnonzero(usable)
        fg, fy = self.ug[fit], self.y[fit]

        def steps(lag: int) -> tuple[np.ndarray, np.ndarray]:
            keep = fg[lag:] == fg[:-lag] if len(fg) > lag else np.zeros(0, dtype=bool)
            return (fy[lag:] - fy[:-lag])[keep] if len(fg) > lag else np.zeros(0), fg[lag:][keep] if len(fg) > lag else np.zeros(0, dtype=np.int64)

        d1, g1 = steps(1)
        d3, g3 = steps(3)
        drift = np.where(self.kind, _group_median(d1, g1, self.k), 0.0)
        return drift, _spread(d1, g1, self.k, drift), _spread(d3, g3, self.k, 3 * drift)

    def variances(self, drift: np.ndarray, s1: np.ndarray, s3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        floor = np.where(self.log, 1e-3, 1e-3 * np.abs(self.med)) + 1e-12
        floor = np.where(self.kind, 0.05 * np.abs(drift) + 1e-9, floor)
        return np.maximum(s1, floor) ** 2, np.maximum(s3, floor) ** 2

    def quiet(self, drift: np.ndarray, v1: np.ndarray) -> np.ndarray:
        """Readings in a window of FROZEN_RUN in which the variance of the innovations vanishes.

        The innovations are those of the model without measurement noise, whose gain is one: steps less the drift. (With a
        smaller gain the level creeps up on a frozen value, and the first innovations of a stretch stay large.)
        """
        n, w = len(self.uv), FROZEN_RUN - 1
        out = np.zeros(n, dtype=bool)
        if n <= w:
            return out
        tol = self.tolerance(v1)
        e = np.zeros(n)
        e[1:] = np.diff(self.uv) - drift[self.ug[1:]] * self.kind[self.ug[1:]]
        inside = np.flatnonzero(self.ug[w:] == self.ug[:-w]) + w  # last readings of windows within one shard
        windows = np.lib.stride_tricks.sliding_window_view(e[1:], w)
        with np.errstate(all="ignore"):
            still = inside[windows[inside - w].var(axis=1) <= 4 * tol[inside] ** 2]
        # a window marks its innovations' readings and the one before
        mark = np.zeros(n + 1, dtype=np.int64)
        np.add.at(mark, still - w, 1)
        np.add.at(mark, still + 1, -1)
        return np.cumsum(mark)[:n] > 0

    def tolerance(self, v1: np.ndarray) -> np.ndarray:
        """Largest step between readings that are almost the same."""
        tol = 0.02 * np.sqrt(v1)[self.ug]
        return np.minimum(np.where(self.log[self.ug], tol * np.abs(self.uv), tol), 1e-3 * np.abs(self.uv) + 1e-9)

    def runs(self, drift: np.ndarray, v1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which readings (almost) repeat the one before, and which lie in a frozen stretch.

        Stretches are sought by ``quiet``; there a run of at least FROZEN_RUN times of (almost) one value must stand, which
        tells a frozen sensor from a counter that climbs by equal steps, and gives the stretch its exact ends.
        """
        ug, uv, uts = self.ug, self.uv, self.uts
        still = np.zeros(len(uv), dtype=bool)
        still[1:] = (ug[1:] == ug[:-1]) & (np.abs(np.diff(uv)) <= self.tolerance(v1)[1:])
        if not len(uv):
            return still, still
        head_of = np.maximum.accumulate(np.where(~still, np.arange(len(uv)), 0))
        fresh_ts = np.ones(len(uv), dtype=np.int64)
        fresh_ts[1:] = (ug[1:] != ug[:-1]) | (uts[1:] != uts[:-1])
        length = np.bincount(head_of, weights=fresh_ts, minlength=len(uv))
        return still, (length[head_of] >= FROZEN_RUN) & self.quiet(drift, v1)

    def count(self, which: np.ndarray) -> np.ndarray:
        return np.bincount(self.ug, weights=which, minlength=self.k)


def _natural(n: np.ndarray, outside: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Whether a series is constant by nature: it repeats its value so often that it does so ten times by chance.

    ``outside`` counts its readings outside runs, ``repeats`` those of them that repeat the one before.
    """
    return ((repeats / np.maximum(outside, 1)) ** (FROZEN_RUN - 1) * np.clip(n, 1, SHARD_ROWS) > 0.01) | (outside < 8)


def tally(g: np.ndarray, ts: np.ndarray, v: np.ndarray, counter: np.ndarray, skewed: np.ndarray, impossible: np.ndarray, core: np.ndarray) -> dict[str, np.ndarray]:
    """What a shard tells about its series: mergeable counts of its own readings, and its noise outside of runs."""
    d = _Distinct(g, ts, v, counter, skewed, impossible)
    drift, s1, s3 = d.noise(d.ok)
    still, in_run = d.runs(drift, d.variances(drift, s1, s3)[0])
    own = core[d.u]
    moving = d.ok & ~in_run
    drift, s1, s3 = d.noise(moving)
    return {"n": d.count(own), "outside": d.count(own & ~in_run), "repeats": d.count(own & still & ~in_run), "moving": d.count(own & moving), "drift": drift, "s1": s1, "s3": s3}


def judge(g: np.ndarray, ts: np.ndarray, v: np.ndarray, counter: np.ndarray, skewed: np.ndarray, impossible: np.ndarray, whole: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Innovations and frozen flags of readings sorted by (g, ts); g numbers the shards from 0.

    Equal (ts, value) of a shard is one reading delivered more than once: judged once, the verdict holds for all.
    Shards of fewer than 8 distinct readings get innovations of 0. ``whole`` has, per reading, what the shards of the
    series tell together (NaN: the shard is the series). It decides what is constant by nature, and gives the
    noise of shards that mostly lie in runs.
    """
    d = _Distinct(g, ts, v, counter, skewed, impossible)
    ug, uv, y, k, n, start, kind, log, ok = d.ug, d.uv, d.y, d.k, d.n, d.start, d.kind, d.log, d.ok
    bad = ~ok
    level = np.where(log, np.log(1.02 * np.abs(d.med) + 1e-300), d.med)
    # steps between usable neighbours give noise, drift of counters, and how fast the level wanders
    drift, s1, s3 = d.noise(ok)
    still, in_run = d.runs(drift, d.variances(drift, s1, s3)[0])
    outside = d.count(~in_run)
    natural = _natural(n, outside, d.count(still & ~in_run))
    lent = np.zeros(k, dtype=bool)
    if whole is not None:
        of = {c: x[d.u][start] for c, x in whole.items()}
        known = ~np.isnan(of["n"])
        natural = np.where(known, _natural(*(np.nan_to_num(of[c]) for c in ("n", "outside", "repeats"))), natural)
        lent = known & ~np.isnan(of["s1"]) & ~natural & (2 * outside < n)
        drift, s1, s3 = (np.where(lent, of[c], own) for c, own in (("drift", drift), ("s1", s1), ("s3", s3)))
        if lent.any():
            in_run = d.runs(drift, d.variances(drift, s1, s3)[0])[1]
    # a run of equal readings in a series that otherwise moves; such readings are withheld from the filter like any fault
    frozen = in_run & ~natural[ug] & ok
    usable = ok & ~frozen
    again = (d.count(frozen) > 0) & ~lent
    if again.any():  # frozen readings tell nothing of the noise
        drift, s1, s3 = (np.where(again, new, old) for new, old in zip(d.noise(usable), (drift, s1, s3), strict=True))
    v1, v3 = d.variances(drift, s1, s3)
    q = np.where(kind, v1, np.clip((v3 - v1) / 2, 0.01 * v1, v1))
    r = np.where(kind, 0.01 * v1, np.maximum((v1 - q) / 2, 0.05 * v1))
    fit = np.flatnonzero(usable)
    fg, fy = ug[fit], y[fit]
    head = fit[np.concatenate(([True], fg[1:] != fg[:-1]))] if len(fit) else fit
    first = level.copy()
    if len(fit):
        # start from the median of the first readings, so that a faulty first one does not set the level
        place = np.arange(len(fg)) - np.searchsorted(fg, fg)
        early = place < 9
        first = _group_median(fy[early], fg[early], k)
        first[kind] = _counter_start(fy, fg, head, fit, drift, k)[kind]
    z, shift = _filter(y, bad | frozen, n, start, drift, q, r, first)
    z = np.where(shift > 0, 0.0, z)
    scale = np.clip(1.4826 * _group_median(np.abs(z[usable]), ug[usable], k, 1.0), 0.7, 3.0)
    z = np.clip(z / scale[ug], -1e30, 1e30)
    z[(n < 8)[ug]] = 0.0
    # steps of counters have heavier tails than noise has: their innovations count half
    z[kind[ug]] /= 2
    # a fall of a counter to about its usual step is a restart, even with few readings after it
    z[kind[ug] & (uv >= 0) & (z < 0) & (uv <= 8 * np.abs(drift[ug]))] = 0.0
    return z[d.back], frozen[d.back]


def _counter_start(fy: np.ndarray, fg: np.ndarray, head: np.ndarray, fit: np.ndarray, drift: np.ndarray, k: int) -> np.ndarray:
    """Level before a counter's first reading: the median of the first five, each taken back by its place."""
    place = np.arange(len(fg)) - np.searchsorted(fg, fg)
    early = place < 5
    return _group_median(fy[early] - drift[fg[early]] * (place[early] + 1), fg[early], k)


_OUT = pa.schema([("sample_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("m", pa.int64()), ("z", pa.float32()), ("sure", pa.bool_()), ("hist", pa.list_(pa.int64()))])


_WHOLE = ("n", "outside", "repeats", "drift", "s1", "s3")
_TALLY = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("shard", pa.int64()), ("moving", pa.int64()), *[(c, pa.float64()) for c in _WHOLE]])


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in names]


def _numbered(t: pa.Table) -> np.ndarray:
    """Numbers of the shards of readings sorted by shard, from 0."""
    new = np.ones(t.num_rows, dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in _columns(t, "h1", "h2", "shard")])
    return np.cumsum(new) - 1


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Readings sorted by shard -> candidates, sure cases and histograms."""
    for t in _whole_shards(batches):
        imp, core, m, sid, h1, h2 = _columns(t, "impossible", "core", "m", "sample_id", "h1", "h2")
        g = _numbered(t)
        whole = dict(zip(_WHOLE, (x.astype(np.float64) for x in _columns(t, *("w_" + c for c in _WHOLE))), strict=True))
        z, frozen = judge(g, *_columns(t, "ts", "value", "counter", "skewed"), imp, whole)
        size = np.abs(z)
        sure = core & (imp | frozen)
        keep = core & (sure | (size > GATE))
        yield pa.record_batch([sid[keep], h1[keep], h2[keep], m[keep], z[keep].astype(np.float32), sure[keep], pa.nulls(int(keep.sum()), pa.list_(pa.int64()))], schema=_OUT)
        bins = np.minimum(size * 2, _BINS - 1).astype(np.int64)
        first = np.flatnonzero(np.diff(g, prepend=-1))
        # shards of large series keep their own histogram, the others are one per metric
        own = _columns(t, "many")[0][first] | (np.bincount(g[core], minlength=len(first)) >= OWN_GATE_ROWS)
        names, of = np.unique(m[first], return_inverse=True)
        line = np.where(own, len(names) + np.cumsum(own) - 1, of)[g]
        lines = len(names) + int(own.sum())
        counts = np.bincount((line * _BINS + bins)[core], minlength=lines * _BINS).reshape(lines, _BINS)
        series = [pa.array([None] * len(names) + h[first][own].tolist(), pa.int64()) for h in (h1, h2)]
        of_m = np.concatenate([names, m[first][own]])
        yield pa.record_batch([pa.nulls(lines, pa.int64()), *series, of_m, pa.nulls(lines, pa.float32()), pa.nulls(lines, pa.bool_()), pa.array(counts.tolist(), pa.list_(pa.int64()))], schema=_OUT)


def _tally_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Readings sorted by shard -> a row per shard of the series that have several."""
    for t in _whole_shards(b.filter(b.column("many")) for b in batches):
        g = _numbered(t)
        h1, h2, shard = (x[np.flatnonzero(np.diff(g, prepend=-1))] for x in _columns(t, "h1", "h2", "shard"))
        of = tally(g, *_columns(t, "ts", "value", "counter", "skewed", "impossible", "core"))
        yield pa.record_batch([h1, h2, shard, of["moving"].astype(np.int64), *(of[c].astype(np.float64) for c in _WHOLE)], schema=_TALLY)


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole shards, some at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= 300_000:
            t = pa.Table.from_batches(held)
            key = np.stack(_columns(t, "h1", "h2", "shard"))
            last = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            if len(last):  # all but the last shard, which may go on
                cut = int(last[-1]) + 1
                yield t.slice(0, cut)
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _whole_series(shards: DataFrame) -> DataFrame:
    """What all shards of a series tell about it, for each of its shards."""
    merged = shards.groupBy("h1", "h2").agg(
        F.collect_list("shard").alias("shard"),
        *[F.sum(c).alias("w_" + c) for c in ("n", "outside", "repeats")],
        *[F.percentile(c, 0.5, F.col("moving")).alias("w_" + c) for c in ("drift", "s1", "s3")],
    )
    return merged.withColumn("shard", F.explode("shard"))


def _judged(samples: DataFrame, metric_info: DataFrame) -> DataFrame:
    """Candidates (z), sure cases and histograms of all shards, written once to the shared folder."""
    rows = _readings(samples, metric_info)
    skewed = F.coalesce("skewed", F.lit(False)).alias("skewed")
    profile = stored(_profile(rows), "profile")  # a row per metric; its size is checked before it is broadcast
    rows = join_small(rows, profile, "m", "left").select("sample_id", "ts", "value", "h1", "h2", "m", "counter", skewed, "impossible")
    parts = shuffle_width(samples.sparkSession)
    order = ("h1", "h2", "shard", "ts")
    cut = _shards(rows, SHARD_ROWS, HALO_ROWS).repartition(parts, "h1", "h2", "shard")
    # both passes read the same exchange; the join finds the rows of a shard where they lie
    shards = cut.sortWithinPartitions(*order).mapInArrow(_tally_batches, "h1 bigint, h2 bigint, shard bigint, moving bigint, " + ", ".join(f"{c} double" for c in _WHOLE))
    known = cut.join(_whole_series(shards).hint("shuffle_hash"), ["h1", "h2", "shard"], "left").sortWithinPartitions(*order)
    return stored(known.mapInArrow(_judge_batches, "sample_id bigint, h1 bigint, h2 bigint, m bigint, z float, sure boolean, hist array<bigint>"), "spikes")


def _gates(judged: DataFrame, by: list[str], name: str, least: int = 0) -> DataFrame:
    """Per group of at least so many readings the gate: REPORT_GATE, or wider where its usual innovations reach further."""
    bins = judged.where("hist IS NOT NULL").where(F.col(by[0]).isNotNull()).select(*by, F.posexplode("hist").alias("bin", "n")).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    below, total = F.sum("n").over(W.partitionBy(*by).orderBy("bin")), F.sum("n").over(W.partitionBy(*by))
    reach = bins.select(*by, "bin", total.alias("total"), (below / total).alias("share")).where((F.col("share") >= USUAL_SHARE) & (F.col("total") >= least))
    return reach.groupBy(*by).agg(F.greatest(F.lit(REPORT_GATE), F.lit(USUAL_MARGIN) * (F.min("bin") + 1) / 2).alias(name))


def scored_rows(samples: DataFrame, metric_info: DataFrame) -> DataFrame:
    """(sample_id, z, sure, gate) of every row whose innovation passes the basic gate or that is a sure case."""
    judged = _judged(samples, metric_info)
    found = join_small(judged.where("sample_id IS NOT NULL"), _gates(judged, ["m"], "_usual"), "m", "left")
    found = join_small(found, _gates(judged, ["h1", "h2"], "_own", OWN_GATE_ROWS), ["h1", "h2"], "left")
    return found.select("sample_id", "z", "sure", F.coalesce("_own", "_usual").alias("gate"))


def faulty_rows(samples: DataFrame, metric_info: DataFrame) -> DataFrame:
    """The sample_id of every faulty reading.

    Rows with is_deleted true, a NULL or NaN value or a NULL ts are no readings. A repeated delivery gets the verdict of its
    reading. Metrics without an entry are gauges without bounds. A series of fewer than 8 readings can only be faulty
    by its unit's bounds. An empty table gives no rows.
    """
    return scored_rows(samples, metric_info).where("sure OR abs(z) > gate").select("sample_id")
