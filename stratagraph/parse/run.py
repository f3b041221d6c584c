"""Parsing a table of files: one pass gives each file's status, issues and nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.inventory import ScanOptions, ignored, language
from ..schemas import ISSUES, LANGUAGES, NODES
from .backends import Backend, PlainBackend, Unavailable, flatten

_NODE = ",".join(x.strip().replace(" ", ":", 1) for x in NODES.split(",") if not x.strip().startswith("path"))
RESULT = f"path string, language string, status string, has_tree boolean, has_errors boolean, parser_backend string, issues {ISSUES}, nodes array<struct<{_NODE}>>"


def _issue(code: str, message: str, fatal: bool) -> dict:
    return {"code": code, "message": message, "start_line": None, "end_line": None, "fatal": fatal}


def parse_one(backend: Backend, path: str, language: str, text: str | None) -> dict:
    """A failure of a backend is a row, never an exception. A backend with ``languages`` decides itself which it knows."""
    out = {"path": path, "language": language, "has_tree": False, "has_errors": None, "parser_backend": None, "nodes": []}
    if language not in getattr(backend, "languages", LANGUAGES):
        return out | {"status": "UNSUPPORTED_LANGUAGE", "issues": [_issue("parse.language.unsupported", f"No parser for {language}", False)]}
    if text is None:
        return out | {"status": "PARSE_ERROR", "issues": [_issue("parse.io.read-failed", "The file could not be read as UTF-8", True)]}
    try:
        tree = backend.parse(language, text)
    except Unavailable as error:
        return out | {"status": "BACKEND_UNAVAILABLE", "issues": [_issue("parse.backend.unavailable", f"No backend for {language}" if str(error) == language else str(error)[:200], False)]}
    except Exception as error:
        return out | {"status": "BACKEND_UNAVAILABLE", "issues": [_issue("parse.backend.unavailable", str(error)[:200], True)]}
    nodes = [{k: v for k, v in row.items() if k != "path"} for row in flatten(path, tree)]
    bad = tree.has_errors()
    issues = [_issue("parse.syntax.error", "The syntax tree has errors", False)] if bad else []
    return out | {"status": "PARSE_ERROR" if bad else "SUCCESS", "has_tree": True, "has_errors": bad, "parser_backend": getattr(backend, "backends", {}).get(language, backend).name, "issues": issues, "nodes": nodes}


def parse(files: DataFrame, inventory: DataFrame | None = None, backend: Backend | None = None, options: ScanOptions | None = None) -> DataFrame:
    """files (relative_path, content) -> one result row for each file with a language that is not ignored.

    Language and ignore rules follow from the path, so files are classified as they are read; with an
    ``inventory`` its rows decide instead, at the price of a join.
    """
    backend = backend or PlainBackend()
    path, options = F.col("relative_path"), options or ScanOptions()
    if inventory is None:
        rows = files.where(~ignored(path, options)).select("relative_path", "content", language(path).alias("language")).where("language is not null")
    else:
        wanted = inventory.where("not ignored and detected_language is not null").select("relative_path", F.col("detected_language").alias("language"))
        rows = files.select("relative_path", "content").join(wanted, "relative_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pylist()
                found = [parse_one(backend, r["relative_path"], r["language"], r["content"]) for r in part]
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RESULT))
    return rows.mapInArrow(run, RESULT)


def split(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parses, nodes) of result rows; nodes carry their file's language, by which tables of them may be partitioned."""
    nodes = results.select("path", "language", F.explode("nodes").alias("n")).select("path", "n.*", "language")
    return results.drop("nodes"), nodes
