"""The index as one JSON document: written as a stream, read back as tables, with its manifest and the console's summary."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from .. import workspace
from ..operators import export, inventory
from ..schemas import DIAGNOSTICS, ENTITIES, RELATIONSHIPS, SCOPES
from ..sources import repository
from ..sources.repository import Source

if TYPE_CHECKING:
    from .pipeline import Index

#: The arrays of a document and the columns of their tables.
ARRAYS = {"scopes": SCOPES, "entities": ENTITIES, "relationships": RELATIONSHIPS, "diagnostics": DIAGNOSTICS}


def now() -> str:
    return datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")


def camel(name: str) -> str:
    return re.sub(r"_(\w)", lambda m: m.group(1).upper(), name)


def _one(frame: DataFrame) -> dict:
    row = frame.first()
    return {camel(k): v for k, v in row.asDict(recursive=True).items()} if row else {}


def _shown(value: Column, kind: DataType) -> Column:
    """A value with its fields under their names in documents, fields and keys in order."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: camel(f.name))
        return F.when(value.isNotNull(), F.struct(*(_shown(value[f.name], f.dataType).alias(camel(f.name)) for f in fields)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _shown(x, kind.elementType))
    return F.map_from_entries(F.array_sort(F.map_entries(value))) if isinstance(kind, MapType) else value


def _compact(text):  # without hints, which Spark would take for the kind of UDF
    return "null" if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def lines(frame: DataFrame) -> DataFrame:
    """(value): each row as a document holds it, one line: names in camel case and in order, metadata as an object. Made by tasks, in the order of the rows."""
    values = {camel(f.name): _shown(F.col(f.name), f.dataType) for f in sorted(frame.schema, key=lambda f: camel(f.name))}
    if "sourceRefs" in values:
        values["sourceRefs"] = F.coalesce("source_refs", F.array().cast(frame.schema["source_refs"].dataType))
        values["sourceRefs"] = _shown(values["sourceRefs"], frame.schema["source_refs"].dataType)
    whole = "metadata" if "metadata" in values and isinstance(frame.schema["metadata"].dataType, StringType) else None

    def part(names: list[str]) -> list[Column]:
        made = F.to_json(F.struct(*(values[n].alias(n) for n in names)), {"ignoreNullFields": "false"})
        return [F.substr(made, F.lit(2), F.length(made) - 2)] if names else []

    if whole is None:
        parts = part(list(values))
    else:
        own = F.concat(F.lit(f'"{whole}":'), F.udf(_compact, "string")(F.col(whole)))
        parts = [*part([n for n in values if n < whole]), own, *part([n for n in values if n > whole])]
    return frame.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def source_part(source: Source, acquired: str) -> dict:
    return {"repositoryId": source.repository_id, "acquisitionType": source.acquisition, "path": source.folder, "remoteUrl": source.remote_url, "branch": source.branch, "revision": source.revision, "acquiredAt": acquired, "metadata": {}}


def head(result: "Index", source: Source, version: str, started: str | None = None) -> dict:
    """All parts of a document but its arrays of facts. Lists of paths are one repository's."""
    a = _one(result.assessment)
    paths = sorted(r.file_path for r in result.degraded.collect())
    omitted = sorted(r.relative_path for r in result.omitted.collect())
    notes = ["Facts, roles, scopes and relationships between levels were inferred", *a["notes"]]
    totals = _one(result.summaries["inventory"])
    counted = {k: _one(result.summaries[k]) for k in ("parse", "extraction", "interpretation", "topology")}
    by = lambda key: {r.k: r.n for r in result.diagnostics.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).collect()}
    parses = {k: a[k] for k in ("success", "skipped")} | {"backendUnavailable": a["unavailable"], "unsupportedLanguage": a["unsupported"], "parseError": a["errors"], "recoverableParseError": a["recoverable"], "nonRecoverableParseError": a["errors"] - a["recoverable"]}
    ended = now()
    return {
        "schemaVersion": export.SCHEMA_VERSION,
        "indexerVersion": version,
        "runMetadata": {"startedAt": started or ended, "completedAt": ended, "outcome": a["outcome"], "detectedTechnologies": totals["technologies"], "metadata": {"mode": "topology", "inventoryOnly": False, "structuralExtraction": True, "interpretation": True, "topology": True, "degradedPaths": paths}},
        "source": source_part(source, started or ended),
        "completeness": {"status": a["completeness"], "indexedFileCount": a["indexed"], "totalFileCount": a["total"], "degradedFileCount": a["degraded"], "omittedPaths": omitted, "notes": notes},
        "metadata": {
            "inventorySummary": {"totalFiles": totals["totalFiles"], "indexedFiles": totals["indexedFiles"], "ignoredFiles": totals["ignoredFiles"], "detectedLanguages": totals["languages"], "detectedTechnologyMarkers": totals["technologies"]},
            **{f"{k}Summary": v for k, v in counted.items()},
            "diagnosticSummary": {"totalDiagnostics": a["diagnostics"], "fatalCount": a["fatal"], "bySeverity": by("severity"), "byPhase": by("phase"), "parseCounts": parses},
            "partialResult": {"partial": a["outcome"] != "SUCCESS", "degradedPaths": paths, "omittedPaths": omitted, "fatalCount": a["fatal"], "degradedFileCount": a["degraded"], "ignoredFileCount": a["ignored"]},
        },
    }


def text(result: "Index", top: dict) -> Iterator[str | DataFrame]:
    """The document in pieces, texts and tables of lines; facts come in order of their ids."""
    yield "{\n" + ",\n".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False, sort_keys=True)}" for k, v in top.items())
    arrays = {n: getattr(result, n).orderBy("id") for n in ARRAYS} | {"inventoryEntries": inventory.in_order(result.inventory)}
    for name, frame in arrays.items():
        yield f",\n{json.dumps(name)}: ["
        yield lines(frame)
        yield "]"
    yield "\n}\n"


def manifest_path(path: str) -> str:
    return (path[: -len(".json")] if path.endswith(".json") else path) + ".manifest.json"


#: What stands between two facts.
_BETWEEN = ",\n"


def _parts(spark: SparkSession, rows: DataFrame, folder: str) -> Iterator[tuple]:
    """(file system, file, bytes that count): lines that tasks have written below ``folder``, in order and without what would stand after the last one. A file is deleted once the next is asked for."""
    rows.write.option("lineSep", _BETWEEN).text(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {f.getPath().getName(): f for f in files.listStatus(at) if f.getPath().getName().startswith("part-") and f.getLen()}
    names = sorted(found, key=lambda n: (len(n), n))
    for name in names:
        yield files, found[name].getPath(), found[name].getLen() - (len(_BETWEEN) if name == names[-1] else 0)
        files.delete(found[name].getPath(), False)
    workspace.remove(spark, folder)


def _put(spark: SparkSession, path: str, pieces: Iterator[str | DataFrame], work: str | None = None) -> tuple[int, str]:
    """Write texts and tables of lines by Spark's file systems -> (bytes, SHA-256). Tasks write the lines below ``work``, and no line passes through Python here. The file has its name only once it is whole."""
    java = spark._jvm
    at = java.org.apache.hadoop.fs.Path
    target, own = at(path), at(path + ".part")
    files, sha, size = target.getFileSystem(spark._jsc.hadoopConfiguration()), java.java.security.MessageDigest.getInstance("SHA-256"), 0
    stream = java.java.security.DigestOutputStream(files.create(own, True), sha)

    def say(piece: str) -> int:
        raw = piece.encode()
        stream.write(bytearray(raw))
        return len(raw)

    try:
        for piece in pieces:
            if isinstance(piece, str):
                size += say(piece)
                continue
            for n, (store, part, length) in enumerate(_parts(spark, piece, f"{workspace.shared(spark, work)}/lines-{uuid.uuid4().hex}")):
                size += say("" if n else "\n")
                source = store.open(part)
                try:
                    if java.org.apache.commons.io.IOUtils.copyLarge(source, stream, 0, length) != length:
                        raise OSError(f"{part.toString()} is too short")
                finally:
                    source.close()
                size += length
    finally:
        stream.close()
    files.delete(target, False)
    if not files.rename(own, target):
        raise OSError(f"cannot write {path}")
    return size, bytes(sha.digest()).hex()


def manifest(top: dict, counts: dict[str, int], file_name: str, size: int, sha256: str, producer: str) -> dict:
    own = export.contract(producer)
    advice = "do-not-import" if top["runMetadata"]["outcome"] == "FAILED" else "safe-to-import"
    return {
        "exportId": sha256[:12],
        "generatedAt": now(),
        "payloadFileName": file_name,
        "payloadContentType": "application/json",
        "payloadSizeBytes": size,
        "payloadSha256": sha256,
        "contract": own | {"compatibility": export.evaluate(own, top) | {"targetRecommendation": advice}},
        "metadata": {"entityCount": counts["entities"], "relationshipCount": counts["relationships"], "scopeCount": counts["scopes"], "outcome": top["runMetadata"]["outcome"]},
    }


def preview(made: dict) -> str:
    return json.dumps(made, indent=2, ensure_ascii=False)


def write(spark: SparkSession, result: "Index", path: str, source: Source, version: str, started: str | None = None) -> tuple[dict, dict]:
    """Validate, write the document at ``path`` and its manifest beside it, last -> (head, manifest). Raises before any write if a rule is broken."""
    from . import pipeline

    top = head(result, source, version, started)
    pipeline.validate(result, top)
    size, sha = _put(spark, path, text(result, top), result.work)
    counts = {n: getattr(result, n).count() for n in ARRAYS}
    made = manifest(top, counts, path.rsplit("/", 1)[-1], size, sha, version)
    _put(spark, manifest_path(path), iter([preview(made)]))
    return top, made


def read(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """(head, tables) of a stored document; fields that are not known are left out."""
    return repository.document_parts(spark, path, ARRAYS)


def sample(producer: str) -> dict:
    """The least valid document: a repository without files."""
    from ..functions import ids

    at = now()
    empty = {"totalFiles": 0, "indexedFiles": 0, "ignoredFiles": 0, "detectedLanguages": [], "detectedTechnologyMarkers": []}
    scope = {"id": ids.REPO_SCOPE, "kind": "REPOSITORY", "name": "sample", "displayName": "sample", "parentScopeId": None, "sourceRefs": [], "metadata": {"acquisitionType": "LOCAL_PATH"}}
    root = {"id": "entity:inventory:root", "kind": "MODULE", "origin": "INFERRED", "name": "Repository inventory", "displayName": "sample:inventory", "scopeId": ids.REPO_SCOPE, "sourceRefs": [], "metadata": {"indexedFileCount": 0, "totalFileCount": 0, "detectedLanguages": [], "detectedTechnologyMarkers": []}}
    return {
        "schemaVersion": export.SCHEMA_VERSION,
        "indexerVersion": producer,
        "runMetadata": {"startedAt": at, "completedAt": at, "outcome": "SUCCESS", "detectedTechnologies": [], "metadata": {"mode": "inventory", "inventoryOnly": True, "structuralExtraction": False, "interpretation": False, "topology": False, "degradedPaths": []}},
        "source": source_part(Source("sample", "/sample", "LOCAL_PATH"), at),
        "scopes": [scope],
        "entities": [root],
        "relationships": [],
        "diagnostics": [],
        "completeness": {"status": "COMPLETE", "indexedFileCount": 0, "totalFileCount": 0, "degradedFileCount": 0, "omittedPaths": [], "notes": []},
        "metadata": {"inventorySummary": empty},
    }


def console_summary(top: dict, made: dict, source: Source, output: str, plan: dict, runtime: str) -> dict:
    """What a run prints."""
    found, more = top["metadata"]["inventorySummary"], top["metadata"]
    parts = {k: more[k] for k in ("parseSummary", "extractionSummary", "interpretationSummary", "topologySummary", "diagnosticSummary", "partialResult")}
    lists = ("parse_paths", "removed_paths")
    return {
        "status": "ok",
        "repositoryId": source.repository_id,
        "acquisitionType": source.acquisition,
        "sourcePath": source.folder,
        "output": output,
        "schemaVersion": top["schemaVersion"],
        "indexedFiles": found["indexedFiles"],
        "ignoredFiles": found["ignoredFiles"],
        "detectedLanguages": found["detectedLanguages"],
        "detectedTechnologyMarkers": found["detectedTechnologyMarkers"],
        "parserRuntime": runtime,
        **parts,
        "incrementalPlan": {camel(k): v for k, v in plan.items() if k not in lists},
        "incrementalPaths": plan["parse_paths"],
        "exportManifestPreview": made,
    }
