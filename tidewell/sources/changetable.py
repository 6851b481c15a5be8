"""Bucketed copy-on-write table: applies change feeds and keeps the current state of every key.

Layout under the table's path: ``data/<uuid>/bucket=<b>/*.parquet`` and ``manifests/<version>.json``. A manifest
names, per bucket, the folder that holds it; its creation (which fails if the version exists) is the commit. Rows are
hashed by key to buckets and sorted by key inside each file. ``apply`` reduces the changes to the newest per key,
routes them to buckets, merges only the buckets touched, writes replacement files and commits a new manifest. Tombstones
stay in the base, so an older change that arrives later loses to them; readers filter them out.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.files import Folder


class ChangeTable:
    """One table. ``keys`` identify a row, ``version`` columns order its changes (ascending, later is newer)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], version: list[str], buckets: int = 64, deleted: str = "is_deleted"):
        self.spark, self.path, self.keys, self.version, self.buckets, self.deleted = spark, path.rstrip("/"), keys, version, buckets, deleted
        self.folder = Folder(spark, self.path)

    # --- manifests -------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return self.folder.numbers("manifests")

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (default: the newest); an empty one before the first commit."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": {}, "schema": None, "n_buckets": self.buckets}
        at = known[-1] if version is None else version
        if at not in known:
            raise ValueError(f"no version {at}")
        return self.folder.read(f"manifests/{at:012d}.json")

    # --- writing ---------------------------------------------------------------------------------------------------

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rank(self) -> Column:
        return F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in self.version])

    def _newest(self, df: DataFrame) -> DataFrame:
        """Newest change per key, partly combined before the shuffle: a key with many versions is one row per task."""
        rest = [c for c in df.columns if c not in self.keys]
        best = df.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self._rank()).alias("_v"))
        return best.select(*self.keys, *[F.col("_v")[c].alias(c) for c in rest]).select(*df.columns)

    def apply(self, changes: DataFrame) -> dict:
        """Apply changes in any order, repeated or not, and commit; returns the new manifest.

        Changes whose key has a NULL column are applied like any other key. An empty batch commits nothing.
        """
        base = self.manifest()
        if base["n_buckets"] != self.buckets:
            raise ValueError(f"the table has {base['n_buckets']} buckets")
        columns = changes.columns
        new = self._newest(changes).withColumn("bucket", self.bucket_of())
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/{name}"
        held = base["buckets"]
        if held:
            # the touched buckets are at most ``buckets`` numbers; the routed changes are kept for the merge
            new = new.persist()
            touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
            old = self._read(base, [b for b in touched if str(b) in held])
            merged = new if old is None else self._merge(new, old.select(*columns, "bucket"))
        else:
            merged = new
        out = merged.repartition(min(self.buckets, max(1, self.spark.sparkContext.defaultParallelism * 4)), "bucket").sortWithinPartitions("bucket", *self.keys)
        out.write.partitionBy("bucket").parquet(folder)
        if held:
            new.unpersist()
        written = {n[7:] for n in self.folder.names(f"data/{name}") if n.startswith("bucket=")}
        if not written:
            return base
        manifest = {
            "version": base["version"] + 1,
            "n_buckets": self.buckets,
            "schema": json.loads(changes.schema.json()),
            "buckets": held | dict.fromkeys(written, folder),
            "rewritten": len(written),
        }
        self.folder.put_new(f"manifests/{manifest['version']:012d}.json", manifest)
        return manifest

    def _merge(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """Sort-merge of the changes with the touched buckets: per key the newer of the two."""
        rest = [c for c in new.columns if c not in (*self.keys, "bucket")]
        pack = lambda df, name: df.select("bucket", *self.keys, F.struct(self._rank().alias("_rank"), F.struct(*rest).alias("_row")).alias(name))
        a, b = pack(new, "_new").alias("a"), pack(old, "_old").alias("b")
        on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("bucket", *self.keys)])
        both = a.hint("merge").join(b, on, "full_outer")
        win = F.when(F.col("_old").isNull() | (F.col("_new._rank") >= F.col("_old._rank")), F.col("_new._row")).otherwise(F.col("_old._row"))
        picked = both.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in ("bucket", *self.keys)], win.alias("_w"))
        return picked.select(*self.keys, *[F.col("_w")[c].alias(c) for c in rest], "bucket").select(*new.columns)

    # --- reading ---------------------------------------------------------------------------------------------------

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        wanted = manifest["buckets"] if buckets is None else {str(b): manifest["buckets"][str(b)] for b in buckets}
        if not wanted:
            return None
        schema = T.StructType.fromJson(manifest["schema"]).add("bucket", T.IntegerType())
        groups: dict[str, list[str]] = {}
        for b, folder in wanted.items():
            groups.setdefault(folder, []).append(b)
        parts = [
            self.spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/bucket={b}" for b in bs])
            for folder, bs in groups.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    def read(self, version: int | None = None, with_deleted: bool = False) -> DataFrame | None:
        """The state at a version (default: the newest); None before the first commit."""
        df = self._read(self.manifest(version))
        if df is None:
            return None
        df = df.drop("bucket")
        return df if with_deleted else df.where(~F.coalesce(F.col(self.deleted), F.lit(False)))

    def vacuum(self, keep: int = 1) -> int:
        """Drop manifests but the newest ``keep``, and data folders that none of those names; returns how many folders."""
        known = self.versions()
        kept = known[-keep:] if keep > 0 else known[-1:]
        live = {f for v in kept for f in self.manifest(v)["buckets"].values()}
        for v in set(known) - set(kept):
            self.folder.delete(f"manifests/{v:012d}.json")
        names = {f.rsplit("/", 1)[1] for f in live}
        return sum(self.folder.delete(f"data/{n}") for n in self.folder.names("data") if n not in names)
