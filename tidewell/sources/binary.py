"""Row-format files: write-ahead log segments and sorted sample files, read in parallel by file, and written.

Sample: key length u32, key, ts i64, value f64, txn u64, deleted u8, all big-endian. A log segment is a row of
(length u32, CRC-32 u32, sample). A sorted file is samples, an index (key length u32, key, offset u64), a bloom
filter and a footer of six u64: index offset, bloom offset, samples, least ts, greatest ts, magic.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.bloom import KeyFilter

#: Fixed value: size at which a log segment is full.
SEGMENT_BYTES = 64 * 2**20
_TAIL = struct.Struct(">qdQB")
_FOOTER = struct.Struct(">QQQqqQ")
SCHEMA = "series_key string, metric string, labels map<string,string>, ts bigint, value double, txn_id bigint, is_deleted boolean, file string"
_KEY = re.compile(r"([^{]*)(?:\{(.*)\})?", re.S)
_LABEL = re.compile(r'([^=,]+)="((?:[^"\\]|\\.)*)"', re.S)


def split_key(key: str) -> tuple[str, dict[str, str]]:
    """Metric and labels of a series key."""
    m = _KEY.fullmatch(key)
    if not m:
        return key, {}
    return m[1], {k: re.sub(r"\\(.)", r"\1", v) for k, v in _LABEL.findall(m[2] or "")}


def encode(key: str, ts: int, value: float, txn_id: int, is_deleted: bool) -> bytes:
    raw = key.encode()
    return struct.pack(">I", len(raw)) + raw + _TAIL.pack(ts, value, txn_id, is_deleted)


def decode(data: bytes, at: int = 0) -> tuple[tuple, int]:
    """(key, ts, value, txn_id, is_deleted) and the offset behind it; ValueError if the data ends before."""
    if len(data) < at + 4:
        raise ValueError("too short for a key length")
    (n,) = struct.unpack_from(">I", data, at)
    end = at + 4 + n + _TAIL.size
    if len(data) < end:
        raise ValueError("too short for a sample")
    ts, value, txn, deleted = _TAIL.unpack_from(data, at + 4 + n)
    return (data[at + 4 : at + 4 + n].decode("utf-8", "replace"), ts, value, txn, deleted == 1), end


def log_record(sample: bytes) -> bytes:
    return struct.pack(">II", len(sample), crc32(sample)) + sample


def segment_samples(data: bytes) -> Iterator[tuple]:
    """Samples of a log segment; a torn or corrupt record ends the segment, what came before it counts."""
    at = 0
    while at + 8 <= len(data):
        n, crc = struct.unpack_from(">II", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or crc32(body) != crc:
            return
        try:
            yield decode(body)[0]
        except ValueError:
            return
        at += 8 + n


def _footer(data: bytes, magic: int | None) -> tuple[int, int, int, int, int]:
    """Index offset, bloom offset, samples, least and greatest ts; ValueError if they do not fit the file (or the expected magic)."""
    if len(data) < _FOOTER.size:
        raise ValueError("too short for a footer")
    *out, mark = _FOOTER.unpack_from(data, len(data) - _FOOTER.size)
    if not out[0] <= out[1] <= len(data) - _FOOTER.size or (magic is not None and mark != magic):
        raise ValueError("not a sorted file")
    return tuple(out)


def series_samples(data: bytes, key: str, start: int, end: int, magic: int | None = None) -> Iterator[tuple]:
    """Samples of one series with start <= ts <= end: the file's filter and times rule it out, or its index says where to read."""
    index, bloom, _, low, high = _footer(data, magic)
    seen = KeyFilter.decode(data[bloom : len(data) - _FOOTER.size])
    if high < start or low > end or (seen is not None and not seen.may_contain(key)):
        return
    at, places = index, []
    while at < bloom:
        (n,) = struct.unpack_from(">I", data, at)
        places.append((data[at + 4 : at + 4 + n].decode("utf-8", "replace"), *struct.unpack_from(">Q", data, at + 4 + n)))
        at += 12 + n
    for (name, begin), stop in zip(places, [p for _, p in places[1:]] + [index], strict=True):
        if name == key:
            while begin < stop:
                sample, begin = decode(data, begin)
                if start <= sample[1] <= end:
                    yield sample


def sorted_file_samples(data: bytes, magic: int | None = None) -> Iterator[tuple]:
    """All samples of a sorted file."""
    index, _, n, _, _ = _footer(data, magic)
    at = 0
    for _ in range(n):
        sample, at = decode(data, at)
        if at > index:
            raise ValueError("samples run into the index")
        yield sample


def sorted_file(samples: list[tuple], bloom: bytes | None = None, magic: int = 0) -> bytes:
    """Bytes of a sorted file of (key, ts, value, txn_id, is_deleted), sorted here by (key, ts), with a filter of its keys."""
    if bloom is None:
        bloom = KeyFilter.of(sorted({s[0] for s in samples})).encode()
    rows = sorted(samples, key=lambda s: (s[0], s[1]))
    body, index, now = bytearray(), bytearray(), None
    for s in rows:
        if s[0] != now:
            now = s[0]
            raw = now.encode()
            index += struct.pack(">I", len(raw)) + raw + struct.pack(">Q", len(body))
        body += encode(*s)
    times = [s[1] for s in rows] or [0]
    return bytes(body + index + bloom) + _FOOTER.pack(len(body), len(body) + len(index), len(rows), min(times), max(times), magic)


def _read(spark: SparkSession, path: str, pattern: str, samples) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for key, ts, value, txn, deleted in samples(content):
                    metric, labels = split_key(key)
                    rows.append((key, metric, list(labels.items()), ts, value, txn, deleted, name))
                    if len(rows) >= 50_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(go, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.string()]
    names = ["series_key", "metric", "labels", "ts", "value", "txn_id", "is_deleted", "file"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_log_segments(spark: SparkSession, path: str, pattern: str = "*.wal") -> DataFrame:
    """Samples of every log segment in a folder; one task per file (segments rotate at 64 MB)."""
    return _read(spark, path, pattern, segment_samples)


def write_log_segments(samples: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write samples (series_key, ts, value, txn_id, is_deleted) as log segments; returns (file, samples, bytes) per segment.

    Every task writes its own rows to ``<task>-<number>.wal`` in a folder that all executors share, closes (and so syncs)
    a segment at ``segment_bytes`` and goes on in the next. A task that runs again writes the same files over.
    NULL values are written as NaN; the keys and times must not be NULL.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        where.create_dir(root, recursive=True)
        task, held, size, done = None, [], 0, []

        def close() -> None:
            name = f"{root}/{task:06d}-{len(done):06d}.wal"
            with where.open_output_stream(name) as out:
                for r in held:
                    out.write(r)
            done.append((name, len(held), size))

        for b in batches:
            for part, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= segment_bytes:
                    close()
                    held, size = [], 0
                task = part
                held.append(log_record(encode(row[0], row[1], float("nan") if row[2] is None else row[2], row[3], bool(row[4]))))
                size += len(held[-1])
        if held:
            close()
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "samples", "bytes"])

    return samples.select(F.spark_partition_id().alias("task"), "series_key", "ts", "value", "txn_id", "is_deleted").mapInArrow(go, "file string, samples bigint, bytes bigint")


def write_sorted_files(samples: DataFrame, path: str, magic: int = 0) -> DataFrame:
    """Write every partition of (series_key, ts, value, txn_id, is_deleted) as one sorted file; returns (file, samples).

    Give it partitions that fit a task's memory, best cut by range of (series_key, ts).
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        where.create_dir(root, recursive=True)
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if rows:
            name = f"{root}/{rows[0][0]:06d}.sst"
            with where.open_output_stream(name) as out:
                out.write(sorted_file([(k, t, float("nan") if v is None else v, x, bool(d)) for _, k, t, v, x, d in rows], magic=magic))
            yield pa.record_batch([pa.array([name]), pa.array([len(rows)], pa.int64())], names=["file", "samples"])

    return samples.select(F.spark_partition_id().alias("task"), "series_key", "ts", "value", "txn_id", "is_deleted").mapInArrow(go, "file string, samples bigint")


def truncate_log(spark: SparkSession, path: str, keep_from: int) -> int:
    """Delete the segments of a folder whose samples are all of transactions before ``keep_from``; returns how many."""
    from tidewell.sources.files import Folder

    folder = Folder(spark, path)
    old = read_log_segments(spark, path).groupBy("file").agg(F.max("txn_id").alias("t")).where(F.col("t") < keep_from)
    return sum(folder.delete(r.file.rsplit("/", 1)[1]) for r in old.toLocalIterator())


def scan_sorted_files(spark: SparkSession, path: str, key: str, start: int, end: int, pattern: str = "*.sst", magic: int | None = None) -> DataFrame:
    """Samples of one series and time range from every valid sorted file, by filter and index; the others are not decoded."""

    def wanted(data: bytes) -> list[tuple]:
        try:
            return list(series_samples(data, key, start, end, magic))
        except (ValueError, struct.error):
            return []

    return _read(spark, path, pattern, wanted)


def read_sorted_files(spark: SparkSession, path: str, pattern: str = "*.sst", magic: int | None = None) -> DataFrame:
    """Samples of every valid sorted file in a folder; files that are not valid are skipped whole."""

    def valid(data: bytes) -> list[tuple]:
        try:
            return list(sorted_file_samples(data, magic))
        except ValueError:
            return []

    return _read(spark, path, pattern, valid)
