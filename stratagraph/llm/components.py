"""Connected components by alternating stars, over shuffles only.

Each half step moves every edge's end to the least neighbour of its node, so
long paths halve and the work of a step is linear in the edges. The minimum of
a node is aggregated map-side; joins with it read written tables, so that AQE
can split the partition of a hub with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _step(scratch: Scratch, rows: DataFrame, large: bool) -> DataFrame:
    """rows (a, b): one star step. Large: b > a goes to the least of a's neighbourhood; small: b < a does."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        least = least.select("a", F.least("a", "m").alias("m"))
    least = scratch.save(least, "least")
    joined = rows.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    out = scratch.save(out.where("a <> b").distinct(), "edges")
    scratch.drop(least)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether every edge (a, b) goes from a node of one edge to a root: no root has an edge of its own."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return nodes.where("out > 1 or (out = 1 and least = 0)").isEmpty()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """edges (a long, b long), any direction, loops allowed -> (node, component), only of nodes with an edge to another."""
    now = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        wide = _step(scratch, both, True)
        scratch.drop(now)
        now = _step(scratch, wide, False)
        scratch.drop(wide)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
