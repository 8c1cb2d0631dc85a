"""The shared folder, tables that cut lineage, and files in any store that Spark and Arrow know."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(d: DataFrame, name: str) -> DataFrame:
    """d as a table in the shared folder, read back: what was computed once stays as it is."""
    path = f"{shared(d.sparkSession)}/{name}-{uuid.uuid4().hex}"
    d.write.parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path)


def opened(uri: str):
    """(Arrow file system, path in it) of an address, for Python code that runs outside a plan."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Folder:
    """Moves and deletes by the driver, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        p = self.path_of(path)
        return [x.getPath().getName() for x in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path_of(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path_of(path), True)

    def make(self, path: str) -> None:
        self.fs.mkdirs(self.path_of(path))

    def move(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path_of(old), self.path_of(new)):
            raise OSError(f"{old} could not be moved to {new}")
