"""First-wins and precedence rules, with the order of emission as an explicit column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of each key. One aggregation with map-side combine, so a hot key moves one row a task."""
    whole = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(key).agg(F.min_by(whole, order).alias("first")).select("first.*")


def precedence_union(stages: list[DataFrame], key: str, order: str = "ord") -> DataFrame:
    """Of each key the value of the last stage that has it, at the place of the first: columns and (stage, position)."""
    columns = [c for c in stages[0].columns if c != order]
    rows = reduce(DataFrame.unionByName, (s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)))
    value, at = F.struct(*(F.col(c) for c in columns)), F.struct("stage", order)
    out = rows.groupBy(key).agg(F.max_by(value, "stage").alias("value"), F.min(at).alias("position"))
    return out.select("value.*", "position")


def distinct_edges(edges: DataFrame, order: Column) -> DataFrame:
    """edges (from_id, to_id, label, ...): one edge of each pair of unlike ends, the first."""
    apart = edges.where("from_id <> to_id")
    whole = F.struct(*(F.col(c) for c in edges.columns))
    return apart.groupBy("from_id", "to_id").agg(F.min_by(whole, order).alias("first")).select("first.*")
