"""The whole index: files -> inventory, parses, facts, roles, topology, assessment, tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import assess, dedup, export, extract, incremental, interpret, inventory, summaries, topology
from ..operators.extract import source_ref, text_map
from ..parse import run as parsing
from ..parse.backends import Backend

VERSION = "0.1.0"
_ENTITY = ["id", "kind", "origin", "name", "display_name", "scope_id", "source_refs", "metadata"]
_RELATION = ["id", "kind", "from_entity_id", "to_entity_id", "label", "source_refs", "metadata"]
_SCOPE = ["id", "kind", "name", "display_name", "parent_scope_id", "source_refs", "metadata"]


@dataclass(frozen=True)
class Index:
    inventory: DataFrame
    parses: DataFrame
    scopes: DataFrame
    entities: DataFrame
    relationships: DataFrame
    diagnostics: DataFrame
    assessment: DataFrame
    omitted: DataFrame
    degraded: DataFrame
    #: one row each, of the inventory and the stages
    summaries: dict[str, DataFrame]
    #: the folder of what several steps read
    work: str | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {"scopes": self.scopes, "entities": self.entities, "relationships": self.relationships, "diagnostics": self.diagnostics, "assessment": self.assessment}


def _ordered(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.select(*columns, F.to_json(F.struct("ord")).alias("ord"))


def _root(spark: SparkSession, found: DataFrame, repository: str, acquisition: str) -> tuple[DataFrame, DataFrame]:
    """The repository's scope, and the inventory's root entity."""
    one = spark.range(1)
    scope = one.select(
        F.lit(ids.REPO_SCOPE).alias("id"), F.lit("REPOSITORY").alias("kind"), F.lit(repository).alias("name"), F.lit(repository).alias("display_name"), F.lit(None).cast("string").alias("parent_scope_id"),
        _no_refs().alias("source_refs"), F.to_json(text_map(acquisitionType=acquisition)).alias("metadata"), F.lit("").alias("ord"),
    )
    totals = inventory.summary(found)
    first = found.where("not ignored").agg(F.min_by(source_ref(F.col("relative_path"), type=F.col("type")), "relative_path").alias("ref"))
    meta = F.to_json(F.struct(F.col("indexed_files").alias("indexedFileCount"), F.col("total_files").alias("totalFileCount"), F.col("languages").alias("detectedLanguages"), F.col("technologies").alias("detectedTechnologyMarkers")))
    entity = totals.crossJoin(first).select(  # one row each
        F.lit("entity:inventory:root").alias("id"), F.lit("MODULE").alias("kind"), F.lit("INFERRED").alias("origin"), F.lit("Repository inventory").alias("name"), F.lit(f"{repository}:inventory").alias("display_name"),
        F.lit(ids.REPO_SCOPE).alias("scope_id"), F.array_compact(F.array("ref")).alias("source_refs"), meta.alias("metadata"), F.lit("").alias("ord"),
    )
    return scope, entity


def _no_refs():
    return F.array().cast("array<struct<path:string,start_line:int,end_line:int,snippet:string,metadata:map<string,string>>>")


def _scan_note(root: DataFrame, found: DataFrame) -> DataFrame:
    """The note that the scan has ended, on the inventory's root entity."""
    none = F.lit(None).cast("string")
    totals = found.agg(F.count("*").alias("totalFiles"), F.count_if("ignored").alias("ignoredFiles"))
    return root.crossJoin(totals).select(  # one row each
        F.lit("diag:inventory:scan-complete").alias("id"), F.lit("INFO").alias("severity"), F.lit("ACQUISITION").alias("phase"), F.lit("inventory.scan.complete").alias("code"), F.lit("File inventory scan completed").alias("message"),
        F.lit(False).alias("fatal"), none.alias("file_path"), F.lit(ids.REPO_SCOPE).alias("scope_id"), F.col("id").alias("entity_id"), "source_refs", F.to_json(F.struct("totalFiles", "ignoredFiles")).alias("metadata"),
    )


#: columns that hold ids, and the tables whose ids these are
_ENDS = {
    "scopes": {"id": "scopes", "parent_scope_id": "scopes"},
    "entities": {"id": "entities", "scope_id": "scopes"},
    "relationships": {"id": "relationships", "from_entity_id": "entities", "to_entity_id": "entities"},
    "diagnostics": {"scope_id": "scopes", "entity_id": "entities"},
}
#: parts of metadata that hold ids
_SOURCES = {"entities": ("sourceEntityId", "entities"), "relationships": ("sourceRelationshipId", "relationships")}


def _settled(frame: DataFrame, name: str, twice: dict[str, DataFrame]) -> DataFrame:
    """A table of the index with its ids as the index shows them."""
    for column, of in _ENDS[name].items():
        frame = ids.settled(frame, twice[of], column)
    if name in _SOURCES:
        part, of = _SOURCES[name]
        frame = frame.withColumn("__made", F.get_json_object("metadata", f"$.{part}")).withColumn("__shown", F.col("__made"))
        frame = ids.settled(frame, twice[of], "__shown")
        frame = frame.withColumn("metadata", F.coalesce(F.replace("metadata", F.col("__made"), F.col("__shown")), "metadata")).drop("__made", "__shown")
    return frame


def index(spark: SparkSession, files: DataFrame, work: str, repository: str = "repository", acquisition: str = "LOCAL_PATH", backend: Backend | None = None, options: inventory.ScanOptions | None = None, extractors=None, rules=None, resolver=topology.default_resolver, diagnostics: DataFrame | None = None) -> Index:
    """Index a table of files. ``work``: a folder that the cluster shares, for what several steps read. ``diagnostics`` of the acquisition stand in place of the scan's own note."""

    def keep(frame: DataFrame, name: str, *by: str) -> DataFrame:
        frame.write.mode("overwrite").partitionBy(*by).parquet(f"{work}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{work}/{name}")

    found = keep(inventory.inventory(files, options), "inventory")
    parses, nodes = parsing.split(keep(parsing.parse(files, None, backend, options), "parsed"))
    # flat, so that each language's extractor reads its own part, and only the columns it needs
    nodes = keep(nodes, "nodes", "language")
    facts = extract.extract(nodes, parses, extractors)
    facts = extract.Facts(keep(facts.scopes, "fact-scopes"), keep(facts.entities, "fact-entities"), keep(facts.relationships, "fact-relationships"), facts.diagnostics)
    roles, role_edges = (keep(f, n) for f, n in zip(interpret.interpret(facts.entities, rules), ("roles", "role-edges")))
    shape = topology.infer(found, facts.scopes, facts.entities, facts.relationships, resolver)
    shape = topology.Topology(keep(shape.scopes, "shape-scopes"), keep(shape.entities, "shape-entities"), keep(shape.relationships, "shape-relationships"))
    repo_scope, root = _root(spark, found, repository, acquisition)
    in_scope = lambda f: f.withColumn("scope_id", ids.scope_or_repo(F.col("scope_id")))
    all_scopes = dedup.precedence_union([repo_scope, _ordered(facts.scopes, _SCOPE), _ordered(shape.scopes, _SCOPE)], "id")
    all_entities = dedup.precedence_union([root, in_scope(_ordered(facts.entities, _ENTITY)), in_scope(_ordered(roles, _ENTITY)), _ordered(shape.entities, _ENTITY)], "id")
    all_relations = dedup.precedence_union([_ordered(f, _RELATION) for f in (facts.relationships, role_edges, shape.relationships)], "id")
    notes = (_scan_note(root, found) if diagnostics is None else diagnostics).unionByName(assess.parse_diagnostics(parses)).unionByName(facts.diagnostics)
    facts_of = {"scopes": all_scopes, "entities": all_entities, "relationships": all_relations}
    facts_of = {n: keep(f.drop("position"), f"all-{n}") for n, f in facts_of.items()}
    twice = {n: keep(ids.shared(f), f"shared-{n}") for n, f in facts_of.items()}
    out = {n: keep(_settled(f, n, twice), n) for n, f in (facts_of | {"diagnostics": notes}).items()}
    stages = {
        "inventory": inventory.summary(found),
        "parse": summaries.parse_summary(parses),
        "extraction": extract.summary(parses, facts, extractors),
        "interpretation": summaries.interpretation_summary(roles, role_edges),
        "topology": summaries.topology_summary(shape.scopes, shape.entities, shape.relationships),
    }
    return Index(found, parses, **out, assessment=keep(assess.assess(found, parses, out["diagnostics"]), "assessment"), omitted=assess.omitted(found), degraded=assess.degraded(out["diagnostics"], parses), summaries=stages, work=work)


def validate(result: Index, head: dict | None = None) -> None:
    """Raise if a rule is broken; names the first twenty."""
    broken = assess.violations(result.scopes, result.entities, result.relationships).limit(20).collect()
    said = [*(assess.header_violations(head) if head is not None else []), *(r.message for r in broken)]
    if said:
        raise ValueError("invalid index: " + "; ".join(said))


def export_index(spark: SparkSession, result: Index, folder: str, producer: str = VERSION) -> dict:
    """Validate, then write all tables and their manifest; raises before any write if a rule is broken."""
    validate(result)
    tables = result.tables()
    export.write_tables(tables, folder)
    counts = {n: spark.read.parquet(f"{folder}/{n}").count() for n in tables}
    return export.write_manifest(spark, folder, counts, result.assessment.first().outcome, producer)


def document(result: Index, repository: str) -> str:
    """The whole index as one JSON text, for repositories that fit in memory; arrays and keys are sorted."""
    rows = lambda f: [json.loads(r) for r in sorted(f.toJSON().collect())]
    assessment = json.loads(result.assessment.toJSON().first())
    out = {"schemaVersion": export.SCHEMA_VERSION, "indexerVersion": VERSION, "source": {"repositoryId": repository}, "runMetadata": {"outcome": assessment["outcome"]}, "completeness": assessment}
    return json.dumps(out | {n: rows(getattr(result, n)) for n in ("scopes", "entities", "relationships", "diagnostics")}, sort_keys=True, ensure_ascii=False)


def refresh(spark: SparkSession, result: Index, previous: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(changes, plan) against a previous snapshot."""
    changes = incremental.diff(previous, incremental.snapshot(result.inventory))
    return changes, incremental.plan(changes)
