"""A folder of numbered JSON documents on any Hadoop file system, with put-if-absent."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


#: File systems whose rename is atomic and refuses a taken name.
ATOMIC_RENAME = ("hdfs", "viewfs", "abfs", "abfss", "ofs", "o3fs")


class CommitConflict(RuntimeError):
    """Another writer took this number first."""


class Folder:
    """Paths under one root.

    Where the file system offers no put-if-absent (object stores whose rename copies) ``put_new`` raises: two writers could
    both believe that they committed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self._Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def numbers(self, name: str) -> list[int]:
        return [int(n[:-5]) for n in self.names(name) if n.endswith(".json")]

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put_new(self, name: str, content: dict) -> None:
        """Write a document that must not exist: staged whole, then moved to its name, so no reader sees half of it."""
        scheme = self.fs.getScheme()
        if scheme != "file" and scheme not in ATOMIC_RENAME:
            raise ValueError(f"{scheme}: offers no atomic put-if-absent; keep the log on one of {', '.join(ATOMIC_RENAME)} or a local folder")
        staged, target = f"staged/{uuid.uuid4().hex}", self.path(name)
        self.fs.mkdirs(target.getParent())
        out = self.fs.create(self.path(staged), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if scheme == "file":
            local = urlparse(self.root).path if "://" in self.root or self.root.startswith("file:") else self.root
            try:
                os.link(f"{local}/{staged}", f"{local}/{name}")  # fails if the name is taken; a local rename would replace
            except FileExistsError:
                raise CommitConflict(f"{name} exists in {self.root}") from None
            finally:
                self.fs.delete(self.path(staged), False)
        elif self.fs.exists(target) or not self.fs.rename(self.path(staged), target):
            self.fs.delete(self.path(staged), False)
            raise CommitConflict(f"{name} exists in {self.root}")

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)
