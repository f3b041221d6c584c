"""Interpretation: roles and endpoints inferred from extracted entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from .dedup import first_wins
from .extract import ENTITY, RELATION

JAVA_RULE, TS_RULE = "java-backend-high-value", "typescript-frontend-high-value"
# Endings of names and annotations that tell a role.
ENDPOINTS = ["getmapping", "postmapping", "putmapping", "deletemapping", "patchmapping", "requestmapping"]
STARTUP_NAMES = ["main", "renderapp", "startup"]
STARTUP_PATHS = ["/main.ts", "/main.tsx", "/index.tsx", "/bootstrap.ts"]


def primary(field: str) -> Column:
    return F.get(F.col("source_refs"), 0)[field]


def java_service(name: Column, labels: Column) -> Column:
    return text.any_ends_with(labels, ["service"]) | text.ends_with_any(name, ["service", "facade", "manager"])


def java_persistence(name: Column, labels: Column) -> Column:
    return text.any_ends_with(labels, ["repository", "mapper"]) | text.ends_with_any(name, ["repository", "dao", "mapper"])


def java_controller(name: Column, labels: Column) -> Column:
    return text.any_ends_with(labels, ["restcontroller", "controller", "path"]) | text.ends_with_any(name, ["controller"])


def ts_ui_module(name: Column, labels: Column) -> Column:
    return text.any_ends_with(labels, ["component", "ngmodule"]) | text.ends_with_any(name, ["component", "module"])


def ts_service(name: Column, labels: Column) -> Column:
    return text.any_ends_with(labels, ["injectable"]) | text.ends_with_any(name, ["service", "api", "client"])


def ts_startup(name: Column, path: Column) -> Column:
    """``name`` or ``path``, by what tells a startup point, else null."""
    low = F.lower(name)
    by_path = F.lit(False)
    for end in STARTUP_PATHS:
        by_path = by_path | F.coalesce(path.endswith(end), F.lit(False))
    return F.when(low.isin(*STARTUP_NAMES) | low.contains("bootstrap"), "name").when(by_path, "path")


def endpoint_annotation(labels: Column) -> Column:
    """The first label that tells an endpoint, lower-cased, else null."""
    return F.get(F.filter(F.transform(labels, F.lower), lambda x: text.ends_with_any(x, ENDPOINTS)), 0)


def nearest_preceding(points: DataFrame, events: DataFrame, key: str, at: str, payload: list[str], order: str | None = None) -> DataFrame:
    """As-of join: each point with the payload of the last event of its key at or before it; null where there is none.

    One sort per key over both sides instead of a range join, so work does not
    grow with the square of a key. Of events at the same place the one with the least ``order`` counts.
    """
    value = F.struct(*(F.col(c) for c in payload))
    rank = F.col(order) if order else F.lit(None).cast("string")
    left = points.select(F.col(key).alias("k"), F.col(at).alias("a"), F.lit(1).alias("side"), rank.alias("o") if order and order in points.columns else F.lit(None).cast(events.schema[order].dataType if order else "string").alias("o"), F.struct(*(F.col(c) for c in points.columns)).alias("point"), F.lit(None).cast(events.select(value.alias("v")).schema["v"].dataType).alias("v"))
    right = events.select(F.col(key).alias("k"), F.col(at).alias("a"), F.lit(0).alias("side"), rank.alias("o"), F.lit(None).cast(points.select(F.struct(*(F.col(c) for c in points.columns)).alias("p")).schema["p"].dataType).alias("point"), value.alias("v"))
    # latest place last; within a place the first event last
    span = Window.partitionBy("k").orderBy("a", "side", F.col("o").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumn("near", F.last("v", ignorenulls=True).over(span))
    return both.where("side = 1").select("point.*", *(F.col(f"near.{c}").alias(f"near_{c}") for c in payload))


def _role(rows: DataFrame, rule: str, language: str, kind: str, suffix: str, label: str, match: Column, phase: int) -> tuple[DataFrame, DataFrame]:
    target = ids.inferred_entity_id(f"interpret-{kind.lower()}", F.col("id"))
    meta = F.to_json(F.struct(F.col("id").alias("sourceEntityId"), F.lit(rule).alias("ruleId"), F.lit(kind).alias("interpretedKind"), match.alias("matchType")))
    at = F.struct(F.col("ord"), F.lit(phase).alias("n"))
    values = [target, F.lit(kind), F.lit("INFERRED"), F.col("name"), F.concat("display_name", F.lit(suffix)), F.col("scope_id"), F.col("source_refs"), meta, F.col("language"), F.array().cast("array<string>"), F.lit(None).cast("string"), at]
    roles = rows.select(*(v.alias(n) for v, n in zip(values, ENTITY)))
    meta = F.to_json(F.struct(F.lit(rule).alias("ruleId"), F.lit(language).alias("sourceLanguage")))
    values = [ids.relationship_id("interpret-uses", F.col("id"), target, F.lit(label)), F.lit("USES"), F.col("id"), target, F.lit(label), F.col("source_refs"), meta, at]
    return roles, rows.select(*(v.alias(n) for v, n in zip(values, RELATION)))


def _endpoints(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    verb = endpoint_annotation(F.col("labels"))
    rows = entities.where("kind = 'FUNCTION' and lower(language) = 'java'").withColumns({"verb": verb, "path": primary("path"), "line": primary("start_line")}).where("verb is not null")
    snippet = F.coalesce(primary("snippet"), F.lit("null"))
    rows = rows.withColumns({"method": text.http_method(F.col("verb")), "route": text.endpoint_path(snippet)})
    target = ids.inferred_entity_id("interpret-endpoint", F.col("id"), F.col("method"), F.col("route"))
    called = F.concat_ws(" ", "method", "route")
    meta = F.to_json(F.struct(F.col("id").alias("sourceEntityId"), F.lit(JAVA_RULE).alias("ruleId"), F.col("method").alias("httpMethod"), F.col("route").alias("path"), F.lit("java").alias("sourceLanguage")))
    at = F.struct(F.col("ord"), F.lit(0).alias("n"))
    values = [target, F.lit("ENDPOINT"), F.lit("INFERRED"), called, F.concat("display_name", F.lit(" endpoint "), called), F.col("scope_id"), F.col("source_refs"), meta, F.col("language"), F.array().cast("array<string>"), F.lit(None).cast("string"), at]
    endpoints = rows.select(*(v.alias(n) for v, n in zip(values, ENTITY)))
    types = entities.where("kind in ('CLASS', 'INTERFACE')").select(primary("path").alias("path"), primary("start_line").alias("line"), "id", "name", "labels", "ord")
    near = nearest_preceding(rows.select("path", "line", F.col("id").alias("method_id"), "method", "route", "source_refs", "ord"), types, "path", "line", ["id", "name", "labels"], "ord")
    fits = java_controller(F.col("near_name"), F.col("near_labels")) | (F.size("near_labels") > 0)
    # the file's module, by any of its names, owns endpoints without a fitting type above
    modules = entities.where("kind = 'MODULE'").select("id", "ord", F.explode(F.array_distinct(F.array("name", "display_name", F.get_json_object("metadata", "$.relativePath")))).alias("path")).where("path is not null")
    modules = modules.groupBy("path").agg(F.min_by("id", "ord").alias("module_id"))
    owned = near.join(modules, "path", "left").withColumn("owner", F.coalesce(F.when(fits, F.col("near_id")), "module_id")).where("owner is not null")
    target = ids.inferred_entity_id("interpret-endpoint", F.col("method_id"), F.col("method"), F.col("route"))
    meta = F.to_json(F.struct(F.lit(JAVA_RULE).alias("ruleId"), F.lit("java").alias("sourceLanguage")))
    values = [ids.relationship_id("interpret-exposes", F.col("owner"), target, called), F.lit("EXPOSES"), F.col("owner"), target, called, F.col("source_refs"), meta, at]
    return endpoints, owned.select(*(v.alias(n) for v, n in zip(values, RELATION)))


def java_rule(entities: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    types = entities.where("lower(language) = 'java' and kind in ('CLASS', 'INTERFACE')")
    name, labels, match = F.col("name"), F.col("labels"), F.lit("annotation-or-name")
    parts = [
        _role(types.where(java_service(name, labels)), JAVA_RULE, "java", "SERVICE", " service", "interpreted-as-service", match, 0),
        _role(types.where(java_persistence(name, labels)), JAVA_RULE, "java", "PERSISTENCE_ADAPTER", " persistence adapter", "interpreted-as-persistence-adapter", match, 1),
        _endpoints(entities),
    ]
    return [p[0] for p in parts], [p[1] for p in parts]


def typescript_rule(entities: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    own = entities.where("lower(language) = 'typescript'").withColumn("startup", ts_startup(F.col("name"), primary("path")))
    name, labels, match = F.col("name"), F.col("labels"), F.lit("decorator-or-name")
    parts = [
        _role(own.where(ts_ui_module(name, labels)), TS_RULE, "typescript", "UI_MODULE", " ui module", "interpreted-as-ui-module", match, 2),
        _role(own.where(ts_service(name, labels)), TS_RULE, "typescript", "SERVICE", " service", "interpreted-as-service", match, 3),
        _role(own.where("startup is not null"), TS_RULE, "typescript", "STARTUP_POINT", " startup point", "interpreted-as-startup-point", F.col("startup"), 4),
    ]
    return [p[0] for p in parts], [p[1] for p in parts]


RULES = [java_rule, typescript_rule]


def interpret(entities: DataFrame, rules=None) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) that the rules infer, the first of each id; a rule is any function of that shape."""
    found, linked = [], []
    for i, rule in enumerate(rules or RULES):
        for frames, out in zip(rule(entities), (found, linked)):
            out += [f.withColumn("ord", F.struct(F.lit(i).alias("rule"), F.col("ord").alias("at"))) for f in frames]
    one = lambda frames: first_wins(reduce(DataFrame.unionByName, frames), "id", F.col("ord"))
    return one(found), one(linked)
