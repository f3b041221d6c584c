"""Folders that the whole cluster shares, and tables in them."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def uri(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def local(path: str) -> str:
    """The path of a folder that all machines mount."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError("this needs a workspace on a file system that all machines mount")
    return path.removeprefix("file://")


def shared(spark: SparkSession, given: str | None = None) -> str:
    """The folder given, else ``spark.checkpoint.dir``. Only where all runs in one process may it be a new local one."""
    found = given or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("a workspace that the cluster shares must be given, or spark.checkpoint.dir be set")
        found = tempfile.mkdtemp(prefix="stratagraph-")
    return uri(found.rstrip("/"))


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Tables that several steps read, in a folder of their own that goes with ``close`` or when the process ends."""

    def __init__(self, spark: SparkSession, name: str, given: str | None = None):
        self.spark, self.root = spark, f"{shared(spark, given)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._last)

    def keep(self, frame: DataFrame, name: str, *by: str) -> DataFrame:
        frame.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.root}/{name}")

    def close(self) -> None:
        atexit.unregister(self._last)
        remove(self.spark, self.root)

    def _last(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # the session may be gone by now; the folder is only scratch
            pass
