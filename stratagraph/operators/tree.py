"""Syntax trees as nested sets: a node's subtree is the range pre..last of its path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ["identifier", "type_identifier", "property_identifier"]
#: Places in pre-order that share a join key, so that a subtree is compared with what lies near it and not with its whole file.
CHUNK = 256


def node_count(pre: Column, last: Column) -> Column:
    return last - pre + 1


def descendants(above: DataFrame, nodes: DataFrame, types: list[str], prefix: str = "d_") -> DataFrame:
    """Rows of ``above`` (path, pre, last, ...) with each node of the types in their subtree, itself included.

    An equality on path and chunk of the pre-order makes it a hash or merge join; the range is
    its residual, so work follows the size of the result and not the square of a file.
    """
    chunk = lambda c: F.floor(c / CHUNK).cast("int")
    below = nodes.where(F.col("type").isin(*types)).select(F.col("path").alias("path"), *(F.col(c).alias(prefix + c) for c in nodes.columns if c != "path"))
    below = below.withColumn("__chunk", chunk(F.col(prefix + "pre")))
    spans = above.where(F.col("last") >= F.col("pre")).withColumn("__chunk", F.explode(F.sequence(chunk(F.col("pre")), chunk(F.col("last")))))
    joined = spans.join(below, ["path", "__chunk"]).drop("__chunk")
    return joined.where((F.col(prefix + "pre") >= F.col("pre")) & (F.col(prefix + "pre") <= F.col("last")))


def _next(above: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """(path, pre, found): for each (path, pre, last) of ``above`` the text of the first node of the types in its subtree, as a struct; null if there is none.

    One sort of each path over both sides, from its end on, in place of a range join.
    """
    none = F.lit(None)
    kind = "struct<pre:int,text:string>"
    events = nodes.where(F.col("type").isin(*types)).select("path", F.col("pre").cast("int").alias("pre"), none.cast("int").alias("last"), F.lit(0).alias("side"), F.struct(F.col("pre").cast("int").alias("pre"), F.col("text").cast("string").alias("text")).alias("node"))
    points = above.select("path", F.col("pre").cast("int").alias("pre"), F.col("last").cast("int").alias("last"), F.lit(1).alias("side"), none.cast(kind).alias("node"))
    so_far = Window.partitionBy("path").orderBy(F.col("pre").desc(), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = events.unionByName(points).withColumn("near", F.last("node", ignorenulls=True).over(so_far))
    return both.where("side = 1").select("path", "pre", F.when(F.col("near.pre") <= F.col("last"), F.col("near")).alias("found")).dropDuplicates(["path", "pre"])


def first_descendant(above: DataFrame, nodes: DataFrame, types: list[str], name: str) -> DataFrame:
    """``above`` with the text of the first such node in pre-order as ``name``, null if there is none."""
    return above.join(_next(above, nodes, types).select("path", "pre", F.col("found.text").alias(name)), ["path", "pre"], "left")


def has_descendant(above: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Rows of ``above`` whose subtree holds a node of the type."""
    return above.join(_next(above, nodes, [kind]).where("found is not null").select("path", "pre"), ["path", "pre"], "left_semi")


def _ends(key: tuple, table: pa.Table) -> pa.Table:
    """One path's nodes with their ranges' ends, by one pass with a stack."""
    table = table.sort_by("pre")
    pre, depth = (np.asarray(table[c]).tolist() for c in ("pre", "depth"))
    last, open_ = [pre[-1]] * len(pre), []
    for i, d in enumerate(depth):
        while open_ and depth[open_[-1]] >= d:
            last[open_.pop()] = pre[i] - 1
        open_.append(i)
    return table.append_column("last", pa.array(last, pa.int32()))


def nested(rows: DataFrame) -> DataFrame:
    """rows (path, pre, depth, ...) in pre-order by depth -> with ``last``: the subtree ends before the next node that is no deeper. One path's nodes are held at a time."""
    schema = T.StructType([*rows.schema.fields, T.StructField("last", T.IntegerType())])
    return rows.groupBy("path").applyInArrow(_ends, schema)
