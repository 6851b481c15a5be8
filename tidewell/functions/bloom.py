"""Bloom filters as mergeable bitmaps, built by an aggregate and tested by a column expression.

The store itself uses Parquet's own bloom filters; this is for pruning by key sets of one's own. ``KeyFilter`` is the byte
form inside row-format files.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size(n: int, rate: float = 0.01) -> tuple[int, int]:
    """(bits, hash functions) for n keys at a false-positive rate; at least 64 bits and 1 to 30 functions."""
    bits = max(64, math.ceil(-max(n, 1) * math.log(rate) / math.log(2) ** 2))
    return bits, min(30, max(1, math.ceil(bits / max(n, 1) * math.log(2))))


def positions(key: Column, bits: int, hashes: int) -> Column:
    """Bit positions of a key by double hashing."""
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1)).bitwiseOR(F.lit(1))
    mask = F.lit(2**31 - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a.bitwiseAND(mask) + i * b.bitwiseAND(mask), F.lit(bits)))


def build(df: DataFrame, key: str, bits: int, hashes: int, by: list[str] | None = None) -> DataFrame:
    """Words (by..., word, mask) of the filter of every group; unions of filters are ``bit_or`` of masks."""
    by = by or []
    at = df.where(F.col(key).isNotNull()).select(*by, F.explode(positions(F.col(key), bits, hashes)).alias("_p"))
    return at.groupBy(*by, F.expr("_p div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("mask"))


def might_contain(df: DataFrame, key: str, words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter: never loses one that is."""
    asked = df.select(key).where(F.col(key).isNotNull()).distinct().select(key, F.explode(positions(F.col(key), bits, hashes)).alias("_p"))
    asked = asked.select(key, F.expr("cast(_p div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(_p % 64 as int))").alias("_bit"))
    hit = asked.join(words, "word", "left").groupBy(key).agg(F.bool_and(F.coalesce(F.col("mask").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).alias("_in"))
    return df.join(hit.where("_in").select(key), key, "left_semi")


_M64 = 2**64 - 1


def _mix(x: int) -> int:
    """Finalizer of MurmurHash3: every input bit reaches every output bit."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor & _M64
    return x ^ x >> 33


def murmur128(data: bytes) -> tuple[int, int]:
    """The two halves of MurmurHash3 x64 128 with seed 0."""
    rotate = lambda x, r: (x << r | x >> 64 - r) & _M64
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    k1_of = lambda k: rotate(k * c1 & _M64, 31) * c2 & _M64
    k2_of = lambda k: rotate(k * c2 & _M64, 33) * c1 & _M64
    h1 = h2 = 0
    whole = len(data) // 16 * 16
    for a, b in struct.iter_unpack("<QQ", data[:whole]):
        h1 = ((rotate(h1 ^ k1_of(a), 27) + h2) * 5 + 0x52DCE729) & _M64
        h2 = ((rotate(h2 ^ k2_of(b), 31) + h1) * 5 + 0x38495AB5) & _M64
    rest = data[whole:]
    h2 ^= k2_of(int.from_bytes(rest[8:], "little"))
    h1 ^= k1_of(int.from_bytes(rest[:8], "little"))
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = h1 + h2 & _M64
    h2 = h2 + h1 & _M64
    h1, h2 = _mix(h1), _mix(h2)
    h1 = h1 + h2 & _M64
    return h1, h2 + h1 & _M64


class KeyFilter:
    """Filter of the keys of one file: bit count u64, hash functions u32 (big-endian), then the bits, the lowest of a byte first."""

    def __init__(self, bits: int, hashes: int, data: bytearray | None = None):
        self.bits, self.hashes = bits, hashes
        self.data = data if data is not None else bytearray(-(-bits // 8))

    @classmethod
    def of(cls, keys: list[str], rate: float = 0.01) -> KeyFilter:
        out = cls(*size(len(keys), rate))
        for k in keys:
            for at in out._at(k):
                out.data[at >> 3] |= 1 << (at & 7)
        return out

    @classmethod
    def decode(cls, raw: bytes) -> KeyFilter | None:
        """None where there is no filter: nothing can then be ruled out."""
        if len(raw) < 12:
            return None
        bits, hashes = struct.unpack_from(">QI", raw)
        return cls(bits, hashes, bytearray(raw[12:])) if bits and len(raw) - 12 >= -(-bits // 8) else None

    def encode(self) -> bytes:
        return struct.pack(">QI", self.bits, self.hashes) + bytes(self.data)

    def _at(self, key: str) -> list[int]:
        h1, h2 = murmur128(key.encode())
        return [(h1 + i * h2 & _M64) % self.bits for i in range(self.hashes)]

    def may_contain(self, key: str) -> bool:
        return all(self.data[at >> 3] >> (at & 7) & 1 for at in self._at(key))
