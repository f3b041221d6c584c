"""Summaries of stages: counts by language, status, kind and rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """One row with a map from the key's values to their numbers, in order of the keys."""
    by = rows.groupBy(key.alias("k")).agg(F.count("*").cast("int").alias("n"))
    return by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "n"))))).alias(name))


def _beside(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(b), frames)  # one row each


def parse_summary(parses: DataFrame) -> DataFrame:
    """Parseable and successful files, by language and by status."""
    total = parses.agg(F.count("*").alias("parseable"), F.count_if((F.col("status") == "SUCCESS") & F.col("has_tree")).alias("successful"))
    return _beside([total, counts(parses, F.col("language"), "by_language"), counts(parses, F.col("status"), "by_status")])


def interpretation_summary(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Inferred facts by kind, and matches of each rule over both kinds of facts."""
    rule = F.get_json_object("metadata", "$.ruleId")
    matched = entities.select(rule.alias("rule")).unionByName(relationships.select(rule.alias("rule")))
    return _beside([counts(entities, F.col("kind"), "entities_by_kind"), counts(relationships, F.col("kind"), "relationships_by_kind"), counts(matched, F.col("rule"), "matches_by_rule")])


def topology_summary(scopes: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    parts = []
    for name, frame in (("scopes", scopes), ("entities", entities), ("relationships", relationships)):
        parts += [frame.agg(F.count("*").alias(name)), counts(frame, F.col("kind"), f"{name}_by_kind")]
    return _beside(parts)
