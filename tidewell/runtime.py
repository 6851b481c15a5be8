"""Session helpers: shared scratch folders, lineage cuts, and broadcasts behind a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (one machine) a temporary folder is made and kept for
    the session; on a cluster an absent setting is an error, since executors do not share a machine's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there is deleted when the session's JVM ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_none(df: DataFrame, max_rows: int) -> DataFrame | None:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows (it is counted no further), else None."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else None


def join_small(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", max_rows: int = 100_000) -> DataFrame:
    """Join a dimension: by broadcast if its counted size is within ``max_rows``, else by shuffle."""
    small = small_or_none(right, max_rows)
    return left.join(right.hint("merge") if small is None else small, on, how)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, at least the default parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
