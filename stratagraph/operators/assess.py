"""Diagnostics, run outcome, completeness, and validation of the assembled tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..schemas import SOURCE_REF


def parse_diagnostics(parses: DataFrame) -> DataFrame:
    """One diagnostic for each parse issue, its severity by the parse's status."""
    rows = parses.select("*", F.posexplode("issues").alias("n", "issue"))
    status = F.col("status")
    severity = F.when(status.isin("SUCCESS", "SKIPPED"), "INFO").when(status == "PARSE_ERROR", "ERROR").otherwise("WARNING")
    none = F.lit(None).cast("string")
    ref = F.struct(F.col("path").alias("path"), F.col("issue.start_line").alias("start_line"), F.col("issue.end_line").alias("end_line"), none.alias("snippet"), F.create_map(F.lit("language"), F.col("language")).alias("metadata"))
    meta = F.to_json(F.struct(status.alias("parseStatus"), F.col("language").alias("parseLanguage"), F.col("parser_backend").alias("parserBackend")))
    return rows.select(
        F.concat(F.lit("diag:parse:"), F.translate("path", "\\/ ", "::_"), F.lit(":"), F.col("n").cast("string")).alias("id"),
        severity.alias("severity"),
        F.lit("EXTRACTION").alias("phase"),
        F.col("issue.code").alias("code"),
        F.col("issue.message").alias("message"),
        F.col("issue.fatal").alias("fatal"),
        F.col("path").alias("file_path"),
        none.alias("scope_id"),
        none.alias("entity_id"),
        F.array(ref).alias("source_refs"),
        meta.alias("metadata"),
    )


def warnings(rows: DataFrame, stage: str, phase: str, code: str, message: Column, file_path: Column, severity: str = "WARNING", scope_id: Column | None = None, entity_id: Column | None = None, **metadata: Column) -> DataFrame:
    """A diagnostic for each row, for rules and extractors of one's own; none of ours makes any."""
    none = F.lit(None).cast("string")
    ref = F.struct(file_path.alias("path"), none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), none.alias("snippet"), F.create_map().cast("map<string,string>").alias("metadata"))
    return rows.select(
        F.concat(F.lit(f"diag:{stage}:"), ids.stable_token(F.concat_ws(":", F.lit(code), file_path, message))).alias("id"),
        F.lit(severity).alias("severity"),
        F.lit(phase).alias("phase"),
        F.lit(code).alias("code"),
        message.alias("message"),
        F.lit(False).alias("fatal"),
        file_path.alias("file_path"),
        (none if scope_id is None else scope_id).alias("scope_id"),
        (none if entity_id is None else entity_id).alias("entity_id"),
        F.when(file_path.isNotNull(), F.array(ref)).otherwise(F.array().cast(f"array<{SOURCE_REF}>")).alias("source_refs"),
        F.to_json(F.struct(*(v.alias(k) for k, v in metadata.items()))).alias("metadata") if metadata else F.lit("{}").alias("metadata"),
    )


def degraded(diagnostics: DataFrame, parses: DataFrame | None = None) -> DataFrame:
    """(file_path) of files that a diagnostic over INFO or a failed parse names."""
    told = diagnostics.where(F.col("file_path").isNotNull() & ((F.col("severity") != "INFO") | F.col("fatal"))).select("file_path")
    if parses is not None:
        failed = F.col("status").isin("BACKEND_UNAVAILABLE", "UNSUPPORTED_LANGUAGE") | ((F.col("status") == "PARSE_ERROR") & ~F.col("has_tree"))
        told = told.unionByName(parses.where(failed).select(F.col("path").alias("file_path")))
    return told.distinct()


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    """(severity, phase, n, fatal)."""
    return diagnostics.groupBy("severity", "phase").agg(F.count("*").alias("n"), F.count_if("fatal").alias("fatal"))


def outcome(fatal: Column, degraded_files: Column) -> Column:
    return F.when(fatal > 0, "FAILED").when(degraded_files > 0, "PARTIAL").otherwise("SUCCESS")


def completeness(fatal: Column, degraded_files: Column) -> Column:
    """Partial also where the run failed."""
    return F.when((fatal > 0) | (degraded_files > 0), "PARTIAL").otherwise("COMPLETE")


def notes(c: dict[str, Column]) -> Column:
    def note(n: Column, what: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" file(s) {what}")))

    found = [
        note(c["recoverable"], "with parse errors that left a syntax tree"),
        note(c["errors"] - c["recoverable"], "with parse errors that left none"),
        note(c["unavailable"], "whose parser could not be used"),
        note(c["unsupported"], "in languages that no parser knows"),
        note(c["ignored"], "left out by the ignore rules"),
        F.when(c["fatal"] > 0, F.lit("Some diagnostics are fatal")),
    ]
    return F.array_compact(F.array(*found))


def omitted(inventory: DataFrame) -> DataFrame:
    """(relative_path) of ignored files, a row each."""
    return inventory.where("ignored").select("relative_path")


def assess(inventory: DataFrame, parses: DataFrame, diagnostics: DataFrame, listed: bool = True) -> DataFrame:
    """One row: outcome, completeness, counts and notes. ``listed``: ignored paths as a sorted list, for one repository's document; without it only ``omitted`` has them, as rows."""
    status = F.col("status")
    of = lambda name: F.count_if(status == name)
    paths = [F.array_sort(F.collect_list(F.when(F.col("ignored"), F.col("relative_path")))).alias("omitted_paths")] if listed else []
    rows = [
        diagnostics.agg(F.count("*").alias("diagnostics"), F.count_if("fatal").alias("fatal")),
        degraded(diagnostics, parses).agg(F.count("*").alias("degraded")),
        parses.agg(of("SUCCESS").alias("success"), of("SKIPPED").alias("skipped"), of("BACKEND_UNAVAILABLE").alias("unavailable"), of("UNSUPPORTED_LANGUAGE").alias("unsupported"), of("PARSE_ERROR").alias("errors"), F.count_if((status == "PARSE_ERROR") & F.col("has_tree")).alias("recoverable")),
        inventory.agg(F.count("*").alias("total"), F.count_if("ignored").alias("ignored"), *paths),
    ]
    one = reduce(lambda a, b: a.crossJoin(b), rows)  # one row each
    c = {n: F.col(n) for n in one.columns}
    return one.select(outcome(c["fatal"], c["degraded"]).alias("outcome"), completeness(c["fatal"], c["degraded"]).alias("completeness"), (c["total"] - c["ignored"]).alias("indexed"), "*", notes(c).alias("notes"))


#: Parts of a document that must be there.
HEADER = ["schemaVersion", "indexerVersion", "runMetadata", "source", "completeness"]


def header_violations(header: dict) -> list[str]:
    """Messages on a document's head: versions that are missing or blank, parts that are missing."""
    missing = lambda v: v is None or isinstance(v, str) and not v.strip()
    return [f"{k} must be present" for k in HEADER if missing(header.get(k))]


def violations(scopes: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(message): ids that are missing or not unique over all three tables, missing names, ends that are no entity."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    tables = {"scope": scopes, "entity": entities, "relationship": relationships}
    out = [t.where(blank(F.col("id"))).select(F.lit(f"{k} id must be present").alias("message")) for k, t in tables.items()]
    out += [t.where(blank(F.col("name"))).select(F.concat(F.lit(f"{k} name must be present for "), F.coalesce("id", F.lit("null"))).alias("message")) for k, t in tables.items() if k != "relationship"]
    every = reduce(DataFrame.unionByName, (t.select("id") for t in tables.values())).where(~blank(F.col("id")))
    again = every.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    out.append(again.select(F.explode(F.array_repeat(F.concat(F.lit("duplicate id within payload: "), "id"), (F.col("n") - 1).cast("int"))).alias("message")))
    known = entities.select(F.col("id").alias("end_id")).distinct()
    for end, said in (("from_entity_id", "fromEntityId"), ("to_entity_id", "toEntityId")):
        lost = relationships.join(known, F.col(end) == F.col("end_id"), "left_anti")
        out.append(lost.select(F.concat(F.lit(f"relationship references missing {said}: "), F.coalesce("id", F.lit("null"))).alias("message")))
    return reduce(DataFrame.unionByName, out)
