"""Extension: a stream of file arrivals, each batch compared with the stored snapshot.

Batch results are those of ``operators.incremental``; a batch replaces what it
names, and each version of the snapshot is written under its batch id, so a
replayed batch gives the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import incremental, inventory
from ..schemas import FILES


def watch(spark: SparkSession, arrivals: str, store: str, checkpoint: str, on_changes) -> StreamingQuery:
    """Follow Parquet files of (relative_path, size, content) and call on_changes(changes, batch id)."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        fresh = incremental.snapshot(inventory.inventory(rows.dropDuplicates(["relative_path"])))
        before = None
        if batch_id:
            before = spark.read.parquet(f"{store}/version={batch_id - 1}")
            kept = before.join(fresh.select("relative_path"), "relative_path", "left_anti")
            after = kept.unionByName(fresh)
        else:
            after = fresh
        after.write.mode("overwrite").parquet(f"{store}/version={batch_id}")
        on_changes(incremental.diff(before, spark.read.parquet(f"{store}/version={batch_id}")), batch_id)

    return spark.readStream.schema(FILES).parquet(arrivals).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
