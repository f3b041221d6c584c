"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and all runs in one process (as in tests), a folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="stratagraph-"))
        found = _OWN[0]
    return found.rstrip("/")


class Scratch:
    """Parquet tables of one operator call, below a folder of its own.

    ``drop`` deletes a table that nothing reads any more; what a returned
    DataFrame still reads goes with ``close``, or when the process ends. What a
    killed process left goes with ``sweep``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._remove, self.root)

    def close(self) -> None:
        """Delete all tables; no DataFrame that reads one may be used after this."""
        self._remove(self.root)
        atexit.unregister(self._remove)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone by now; the folder is only scratch
            pass

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, frame: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write a table and read it; one of few rows that many tasks make is dealt ``by`` a column first, so that it is few files."""
        path = self.path(name)
        (frame.repartition(by) if by else frame).write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._remove(frame._scratch_path)


def sweep(spark: SparkSession, days: float = 7) -> int:
    """Delete folders of operators that nothing was written to for ``days``; gives their number. For folders that no running job uses any more."""
    top = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files, gone = top.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for found in files.listStatus(top) if files.exists(top) else ():
        name, own = found.getPath().getName(), files.listStatus(found.getPath()) if found.isDirectory() else ()
        last = max([found.getModificationTime(), *(x.getModificationTime() for x in own)])
        if re.fullmatch(r"[a-z-]+-[0-9a-f]{32}", name) and last < (time.time() - 86400 * days) * 1000:
            gone += bool(files.delete(found.getPath(), True))
    return gone


def column(frame: DataFrame, name: str) -> Column:
    """A column by its whole name, whatever is in it."""
    return frame["`" + name.replace("`", "``") + "`"]


def as_rows(docs: DataFrame) -> DataFrame:
    """docs -> (row): each row as a struct of its columns; with a ``text`` beside it only where that column is no string."""
    row = F.struct(*(column(docs, c) for c in docs.columns)).alias("row")
    return docs.select(row, *([] if docs.schema["text"].dataType == StringType() else [F.col("text").cast("string").alias("text")]))


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch of ``as_rows``, or its column ``text``."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def input_bytes(frame: DataFrame) -> int:
    """What the optimiser holds for the size of the tables that a frame reads; costs no job."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def pieces_for(frame: DataFrame, each: int, least: int = 16) -> int:
    """How many groups of about ``each`` input bytes a table with a ``text`` gives; texts are summed where no size is known."""
    size = input_bytes(frame)
    if size >= 1 << 55:
        size = frame.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(least, min(1 << 20, size // each + 1))
