"""Snapshots of an inventory, their difference, and what to process again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(inventory: DataFrame, mode: str = "metadata") -> DataFrame:
    """Fingerprints of files that are not ignored: of path, size, language and type, or with ``content`` of the text too."""
    parts = ["relative_path", F.col("size").cast("string"), F.coalesce("detected_language", F.lit("null")), "type"]
    if mode == "content":
        parts.append(F.sha2(F.coalesce("content", F.lit("")), 256))
    rows = inventory.where("not ignored")
    return rows.select("relative_path", F.col("size").alias("size_bytes"), F.sha2(F.concat_ws("|", *parts), 256).alias("content_hash"), "detected_language", F.col("type").alias("file_type"))


def diff(previous: DataFrame | None, current: DataFrame) -> DataFrame:
    """(relative_path, change): added, changed, removed or unchanged; without a previous snapshot all are added."""
    if previous is None:
        return current.select("relative_path", F.lit("added").alias("change"))
    columns = ["size_bytes", "content_hash", "detected_language", "file_type"]
    a = previous.select("relative_path", F.struct(*columns).alias("before"))
    b = current.select("relative_path", F.struct(*columns).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("changed")
    return a.join(b, "relative_path", "full_outer").select("relative_path", change.alias("change"))


def reprocessed(changes: DataFrame) -> DataFrame:
    """(relative_path, change, turn): what to parse again, added paths before changed ones, and what to remove; a row each. Order by turn and path."""
    turn = F.when(F.col("change") == "added", 0).when(F.col("change") == "changed", 1).otherwise(2)
    return changes.where("change <> 'unchanged'").select("relative_path", "change", turn.alias("turn"))


def counts(changes: DataFrame) -> DataFrame:
    """One row: whether an incremental run is useful, numbers of paths by change, and the strategy."""
    rows = changes.agg(*(F.count_if(F.col("change") == k).alias(f"{k}_count") for k in ("added", "changed", "removed", "unchanged")))
    useful = (F.col("added_count") + F.col("changed_count") + F.col("removed_count")) > 0
    return rows.select(useful.alias("incremental"), "*", F.when(useful, "reprocess-added-and-changed").otherwise("full-or-noop").alias("strategy"))


def plan(changes: DataFrame | None) -> DataFrame | None:
    """``counts`` with the paths of ``reprocessed`` as sorted lists, for one repository's summary; without changes one row that is not incremental, with the reason."""
    if changes is None:
        one = SparkSession.active().range(1)
        none = F.array().cast("array<string>")
        return one.select(F.lit(False).alias("incremental"), none.alias("parse_paths"), none.alias("removed_paths"), F.lit("no-diff").alias("reason"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.col("relative_path"))))
    lists = reprocessed(changes).agg(*(of(k).alias(k) for k in ("added", "changed", "removed")))
    # one row each
    rows = counts(changes).crossJoin(lists)
    return rows.select("incremental", F.concat("added", "changed").alias("parse_paths"), F.col("removed").alias("removed_paths"), "added_count", "changed_count", "removed_count", "unchanged_count", "strategy")
