"""Mixture-controlled packing of texts into containers of a fixed number of tokens.

Every source is a queue. A window takes from the queues by deficit round-robin: each window adds a source's share of the
window to its deficit, heads are taken while they fit the deficit, and what is left carries to the next window.
Which tokens of a queue a partition gets follows from the whole: ``schedule`` works out how far each queue has been emptied when so
many tokens have been taken from all, with the shares of queues that have run dry going to the others from there on. A queue
is cut where that line crosses a partition's edge, and by what the last document before the cut reaches over it the partition
after it starts in debt (a negative deficit). So a mixture holds across partitions, and a queue runs dry once, not in each.
Inside a partition the items of a window go, longest first, to the open container with the least room that
still holds them; containers stay open across windows until they are full.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.tokens import count_tokens
from tidewell.runtime import stored

CAPACITY = 2048
WINDOW_CONTAINERS = 64
SHARD_TOKENS = 4_000_000
#: Containers kept open at a time in a partition; beyond it the fullest is closed.
OPEN_CONTAINERS = 512
#: Sources that can be listed; more are an error.
MAX_SOURCES = 2_000


class Packer:
    """Best fit into containers of one capacity, open ones kept sorted by room."""

    def __init__(self, capacity: int, most_open: int = OPEN_CONTAINERS):
        self.capacity, self.most_open, self.open, self.made = capacity, most_open, [], 0

    def put(self, size: int) -> int:
        i = bisect_left(self.open, (size, -1))
        if i < len(self.open):
            room, name = self.open.pop(i)
        else:
            room, name = self.capacity, self.made
            self.made += 1
        if room - size > 0:
            insort(self.open, (room - size, name))
            if len(self.open) > self.most_open:
                self.open.pop(0)
        return name


def schedule(totals: dict[str, float], shares: dict[str, float] | None) -> list[tuple[str, float, float, float, float]]:
    """Pieces (source, from, to, at, rate) of the line along which each queue is emptied.

    While the tokens from ``from`` to ``to`` of a queue are taken, ``rate`` of every token taken from all queues is its; ``at`` tokens
    have been taken from all at the piece's beginning. Queues without a share come when all others are dry, at equal rates.
    """
    left = {s: float(n) for s, n in totals.items() if n > 0}
    done, at, out = dict.fromkeys(left, 0.0), 0.0, []
    weight = (lambda s: float(totals[s])) if shares is None else (lambda s: max(0.0, float(shares.get(s, 0.0))))
    while left:
        whole = sum(map(weight, left))
        rates = {s: (weight(s) / whole if whole > 0 else 1 / len(left)) for s in left}
        step = min(left[s] / r for s, r in rates.items() if r > 0)
        for s, r in rates.items():
            if r > 0:
                dry = left[s] / r <= step * (1 + 1e-12)
                end = float(totals[s]) if dry else done[s] + r * step
                out.append((s, done[s], end, at, r))
                done[s], left[s] = end, 0.0 if dry else left[s] - r * step
        at += step
        left = {s: n for s, n in left.items() if n > 0}
    return out


def round_robin(queues: dict[str, deque], shares: dict[str, float], window_tokens: int, deficit: dict[str, float] | None = None) -> Iterator[list[tuple[int, str, object]]]:
    """Windows of (size, source, item) by deficit round-robin over ``queues`` of (size, item) until all are empty.

    The shares of queues that still hold items are scaled to one, so a source that ran dry leaves its part to the others.
    ``deficit`` is what the sources bring along from before: less than nothing if they have had too much.
    """
    deficit = dict.fromkeys(queues, 0.0) | (deficit or {})
    while any(queues.values()):
        live = [s for s in queues if queues[s]]
        whole = sum(shares.get(s, 0.0) for s in live)
        window = []
        for s in live:
            deficit[s] += window_tokens * (shares.get(s, 0.0) / whole if whole > 0 else 1 / len(live))
            q = queues[s]
            while q and q[0][0] <= deficit[s]:
                size, item = q.popleft()
                deficit[s] -= size
                window.append((size, s, item))
        if window:
            yield window


def _pack_shard(capacity: int, shares: dict[str, float] | None):
    def go(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pos", "row"], kind="stable")
        queues: dict[str, deque] = {}
        deficit: dict[str, float] = {}
        for i, (s, n, pos, start) in enumerate(zip(rows.source, rows.size_, rows.pos, rows.starts, strict=True)):
            if s not in queues:
                queues[s], deficit[s] = deque(), -max(0.0, float(pos - start))
            queues[s].append((int(n), i))
        use = shares or {s: sum(n for n, _ in q) for s, q in queues.items()}
        packer, box, win = Packer(capacity), np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for w, window in enumerate(round_robin(queues, use, capacity * WINDOW_CONTAINERS, deficit)):
            for size, _, i in sorted(window, key=lambda x: (-x[0], x[2])):
                box[i], win[i] = packer.put(size), w
        shard = rows["shard"].to_numpy()
        return pd.DataFrame({"doc_id": rows.doc_id, "piece": rows.piece, "token_start": rows.token_start, "n_tokens": rows.size_, "container_id": shard * 2**32 + box, "window_id": shard * 2**32 + win})

    return go


_OUT = "doc_id bigint, piece bigint, token_start bigint, n_tokens bigint, container_id bigint, window_id bigint"


def pack(documents: DataFrame, capacity: int = CAPACITY, mixture: dict[str, float] | None = None, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per page or piece: doc_id, piece, token_start, n_tokens, container_id, window_id.

    A page longer than ``capacity`` is cut into pieces of exactly ``capacity`` and a rest; other pages stay whole. Full
    pieces have a container of their own (negative id, window NULL). ``mixture`` gives target weights per source
    (default: each source's share of all tokens); a NULL source is a source of its own. Pages with NULL or empty text
    appear with n_tokens 0 and container NULL. ``tokenizer`` is the path of a vocabulary file. Repeated doc_ids are
    separate pages.
    """
    return pack_sized(count_tokens(documents, tokenizer), capacity, mixture, shard_tokens)


def pack_sized(sized: DataFrame, capacity: int = CAPACITY, mixture: dict[str, float] | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """As ``pack``, for (doc_id, source, n_tokens). Sources must be few enough to be listed (at most ``MAX_SOURCES``)."""
    null = F.lit(None).cast("bigint")
    # rows are numbered once and written down: a doc_id may be there more than once
    sized = stored(sized.select("doc_id", F.coalesce("source", F.lit("\0")).alias("source"), "n_tokens", F.monotonically_increasing_id().alias("row")), "sizes")
    full = sized.where(F.col("n_tokens") >= capacity).select("doc_id", F.expr(f"explode(sequence(0L, n_tokens div {capacity}L - 1))").alias("piece"))
    # the sizes are read in the same order at every attempt, so these numbers are fixed, too
    full = full.select("doc_id", "piece", (F.col("piece") * capacity).alias("token_start"), F.lit(capacity).cast("bigint").alias("n_tokens"), (-1 - F.monotonically_increasing_id()).alias("container_id"), null.alias("window_id"))
    empty = sized.where("n_tokens = 0").select("doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("token_start"), "n_tokens", null.alias("container_id"), null.alias("window_id"))
    rest = sized.where(f"n_tokens % {capacity} > 0").select(
        "doc_id", "row", "source", F.expr(f"n_tokens div {capacity}L").alias("piece"), F.expr(f"n_tokens - n_tokens % {capacity}").alias("token_start"), F.expr(f"n_tokens % {capacity}").alias("size_")
    )
    listed = rest.groupBy("source").agg(F.sum("size_").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    totals = {r.source: r.n for r in listed}
    if not totals:
        return full.unionByName(empty)
    total = sum(totals.values())
    shards = max(1, round(total / shard_tokens))
    plan = schedule(totals, mixture and {("\0" if s is None else s): v for s, v in mixture.items()})
    # running token count of each source in hash order: bucket sums first, then inside a bucket, so no source is in one task
    buckets = 4 * shards
    rows = rest.withColumn("_h", F.xxhash64("doc_id", "row")).withColumn("_b", F.expr(f"shiftrightunsigned(_h, 1) div {2**63 // buckets + 1}L"))
    sums = rows.groupBy("source", "_b").agg(F.sum("size_").alias("_n"))
    ahead = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("source", "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    inside = W.partitionBy("source", "_b").orderBy("_h", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(base.hint("shuffle_hash"), ["source", "_b"]).withColumn("pos", F.col("_base") + F.coalesce(F.sum("size_").over(inside), F.lit(0)))
    # each row lies on one piece of its queue's line; the pieces are at most the square of MAX_SOURCES
    line = F.broadcast(sized.sparkSession.createDataFrame([(*p,) for p in plan], "source string, _lo double, _hi double, _at double, _rate double"))
    on = (F.col("pos") >= F.col("_lo")) & (F.col("pos") < F.col("_hi"))
    placed = placed.join(line, "source").where(on).withColumn("shard", F.least(F.floor((F.col("_at") + (F.col("pos") - F.col("_lo")) / F.col("_rate")) * shards / total), F.lit(shards - 1)).cast("bigint"))
    # where the queue stands on that piece as the partition begins: what the row before reaches over it is the debt
    begin = F.col("shard") * F.lit(total / shards)
    placed = placed.withColumn("starts", F.col("_lo") + F.col("_rate") * F.greatest(begin - F.col("_at"), F.lit(0.0)))
    packed = placed.select("doc_id", "row", "source", "piece", "token_start", "size_", "pos", "starts", "shard").groupBy("shard").applyInPandas(_pack_shard(capacity, mixture and {("\0" if s is None else s): v for s, v in mixture.items()}), _OUT)
    return packed.unionByName(full).unionByName(empty)


def check(packed: DataFrame, sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row about a packing of (doc_id, source, n_tokens): pages, tokens_lost, over_capacity, split_needlessly, fill, share_error.

    ``tokens_lost`` and ``split_needlessly`` count pages. ``share_error`` is the greatest difference of a source's share in a
    window from its share of all tokens so packed, over windows that are nine tenths full. doc_ids must be unique.
    """
    per_page = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("_sum"), F.count(F.lit(1)).alias("_pieces"))
    pages = sizes.join(per_page, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(~F.col("n_tokens").eqNullSafe(F.col("_sum"))).alias("tokens_lost"),
        F.count_if(F.col("_pieces") != F.greatest(F.lit(1), F.expr(f"(n_tokens + {capacity - 1}) div {capacity}L"))).alias("split_needlessly"),
    )
    boxes = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("_t"))
    fill = boxes.agg(F.count_if(F.col("_t") > capacity).alias("over_capacity"), (F.sum("_t") / (F.count(F.lit(1)) * capacity)).alias("fill"))
    shares = window_shares(packed, sizes)
    whole = F.sum("tokens").over(W.partitionBy("window_id"))
    of = shares.groupBy("source").agg(F.sum("tokens").alias("_all"))  # a row per source
    total = of.agg(F.sum("_all").alias("_total"))
    errors = shares.withColumn("_w", whole).where(F.col("_w") >= 0.9 * capacity * WINDOW_CONTAINERS).join(F.broadcast(of), "source").join(F.broadcast(total))
    worst = errors.agg(F.coalesce(F.max(F.abs(F.col("tokens") / F.col("_w") - F.col("_all") / F.col("_total"))), F.lit(0.0)).alias("share_error"))
    return pages.join(fill).join(worst)


def window_shares(packed: DataFrame, documents: DataFrame) -> DataFrame:
    """Tokens of every (window_id, source): what the mixture is judged by. doc_ids must be unique."""
    of = documents.select("doc_id", F.coalesce("source", F.lit("\0")).alias("source"))
    return packed.where("window_id IS NOT NULL").join(of, "doc_id").groupBy("window_id", "source").agg(F.sum("n_tokens").alias("tokens"))
