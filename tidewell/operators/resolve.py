"""Version resolution: one live row per (series, ts), and visibility under a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(visible_up_to: int, active: list[int] | tuple[int, ...] = (), txn: str = "txn_id") -> Column:
    """Whether a version is visible: not above the watermark and not of a transaction still in flight."""
    c = F.col(txn) <= visible_up_to
    return c & ~F.col(txn).isin(*active) if active else c


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, tombstones included.

    An aggregate rather than a ranking window: partial states combine before the shuffle, so a key with very many
    versions costs each map task one row. NULLs in ``order`` rank lowest.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.struct(F.col(c).isNotNull(), F.coalesce(F.col(c), F.lit(0))) for c in order])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_v"))
    return picked.select(*keys, *[F.col("_v")[c].alias(c) for c in rest]).select(*df.columns)


def resolve_latest(df: DataFrame, keep_tombstones: bool = False) -> DataFrame:
    """The newest version of each (series_key, ts) by (txn_id, seq); a tombstone hides everything older.

    Call it after the snapshot filter. Rows with equal (txn_id, seq) are repeated deliveries; any one is kept.
    """
    out = newest(df, ["series_key", "ts"], [c for c in ("txn_id", "seq") if c in df.columns])
    return out if keep_tombstones else out.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))
