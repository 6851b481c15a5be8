"""Distinct counts with a known error from mergeable bitmaps (linear counting).

Every identifier sets one bit of a bitmap of ``m`` bits; bitmaps of parts are merged by bitwise OR, and the number of
identifiers is estimated from the share of bits still empty: ``-m ln(empty / m)``. Bitmaps are kept as rows of 64-bit
words, words without a bit left out, so a small group costs a row per identifier, a large one at most ``m / 64``
rows, and all merging is Spark's own hash aggregation with map-side combining; no group gathers in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = ["day", "metric", "tenant", "region"]


def relative_error(n: float, m: int) -> float:
    """Standard error of the estimate, as a share of ``n`` identifiers, with ``m`` bits."""
    t = n / m
    return math.sqrt(m * (math.exp(t) - t - 1)) / n if n > 0 else 0.0


def bitmap_bits(max_distinct: int, target_error: float = 0.01) -> int:
    """The smallest power of two of bits with which every count up to ``max_distinct`` keeps ``target_error``.

    The error is largest at either end: few identifiers collide at a rate of 1 / sqrt(2 m), many fill the bitmap.
    """
    m = 64
    while max_distinct / m > 0.5 * math.log(m) or 1 / math.sqrt(2 * m) > target_error or relative_error(max_distinct, m) > target_error:
        m *= 2
    return m


#: Target of the standard error.
TARGET = 0.01


def size_steps(target_error: float = TARGET) -> list[tuple[int, int]]:
    """(count, bits): up to which count of identifiers each power of two of bits keeps the error; the rule behind ``sized_bits``."""
    out = []
    m = bitmap_bits(1, target_error)
    while m <= 2**37:
        low, high = 1, 64 * m
        while low < high:  # the largest count for which m bits are enough
            mid = (low + high + 1) // 2
            low, high = (mid, high) if bitmap_bits(mid, target_error) <= m else (low, mid - 1)
        out.append((low, m))
        m *= 2
    return out


def sized_bits(rows: int, target_error: float = TARGET) -> int:
    """Bits for a table of so many rows with an identifier: there can be no more identifiers than rows, so the target holds."""
    return next((m for n, m in size_steps(target_error) if rows <= n), 2**37)


def bit_of(identifier: Column, bits: int) -> Column:
    """The bit of an identifier: 60 bits of its MD5, modulo the size. The same in any engine."""
    return F.pmod(F.conv(F.substring(F.md5(identifier.cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(bits))


def partial_bitmaps(df: DataFrame, dims: list[str], identifier: str, bits: int) -> DataFrame:
    """Bitmaps (dims, word, mask) of one part (a day, a file). Rows with a NULL identifier set no bit."""
    at = bit_of(F.col(identifier), bits)
    rows = df.where(F.col(identifier).isNotNull()).select(*dims, at.alias("_bit"))
    word = F.expr("_bit div 64").cast("int").alias("word")
    return rows.groupBy(*dims, word).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("mask"))


def merge(parts: list[DataFrame], dims: list[str]) -> DataFrame:
    """Union of bitmaps of the same size; associative, commutative, and repeating a part changes nothing."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*dims, "word").agg(F.bit_or("mask").alias("mask"))


def estimate(set_bits: Column, bits: int) -> tuple[Column, Column, Column]:
    """(estimate, relative standard error, saturated) from the number of set bits.

    A full bitmap has no finite estimate; m ln(m), the least count that would be expected to fill it, is given and marked.
    """
    m = F.lit(float(bits))
    full = set_bits >= bits
    n = -m * F.log1p(-F.least(set_bits, F.lit(bits - 1)).cast("double") / m)
    n = F.when(full, m * F.log(m)).otherwise(n)
    t = n / m
    # e^t - t - 1 loses all its digits near 0, where its series is exact enough
    excess = F.when(t < 0.01, t * t / 2 + t * t * t / 6).otherwise(F.exp(t) - t - 1)
    return n, F.when(n > 0, F.sqrt(m * excess) / n).otherwise(F.lit(0.0)), full


def distinct_counts(bitmaps: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Estimates for every combination of ``dims`` (a cube): ``grouping`` has a set bit for each dim summed over.

    Columns: grouping, dims, set_bits, estimate, rel_error, saturated. A NULL dim that is not summed over is a
    value of its own. Empty input gives no rows.
    """
    k = len(dims)
    # the bitmaps move once, by word: all groups of a word are then in one task, every union of every combination is
    # local, and only bit counts, one per group and task, move again. Dims are summed over one after the other, each from what
    # the ones before have merged, so a row is not repeated for every combination
    words = bitmaps.repartition("word").select(F.lit(0).alias("grouping"), *dims, "word", "mask")
    for i, c in enumerate(dims):
        kept = F.struct(F.col("grouping").alias("g"), F.col(c).alias("v"))
        summed = F.struct((F.col("grouping") + 2 ** (k - 1 - i)).alias("g"), F.lit(None).cast(bitmaps.schema[c].dataType).alias("v"))
        both = words.withColumn("_s", F.explode(F.array(kept, summed))).withColumn("grouping", F.col("_s.g")).withColumn(c, F.col("_s.v")).drop("_s")
        words = both.groupBy("grouping", *dims, "word").agg(F.bit_or("mask").alias("mask"))
    n = words.groupBy("grouping", *dims).agg(F.sum(F.bit_count("mask")).cast("bigint").alias("set_bits"))
    value, error, full = estimate(F.col("set_bits"), bits)
    return n.select("grouping", *dims, "set_bits", value.alias("estimate"), error.alias("rel_error"), full.alias("saturated"))


def client_rows(seen: DataFrame) -> DataFrame:
    """(day, metric, tenant, region, client) of ``series_seen``."""
    return seen.select(
        F.date_format("seen_at", "yyyy-MM-dd").alias("day"), "metric", F.col("labels")["tenant"].alias("tenant"), F.col("labels")["region"].alias("region"), F.col("labels")["client"].alias("client")
    )


def client_counts(seen: DataFrame, bits: int | None = None) -> DataFrame:
    """Distinct ``client`` label values per UTC day of ``seen_at``, metric, tenant, region and all combinations.

    The bitmaps are sized from the rows that have a client (``sized_bits``) unless ``bits`` is given, as it must be for
    partial results that are to be merged. Rows without labels or without a client set no bit; a missing tenant or region is a NULL group, an empty one "".
    """
    rows = client_rows(seen)
    if bits is None:
        bits = sized_bits(rows.where("client IS NOT NULL").count())
    return distinct_counts(partial_bitmaps(rows, DIMS, "client", bits), DIMS, bits)
