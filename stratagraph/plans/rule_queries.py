"""Registered queries on single rules: paths as rows, gates, diagnostics, names and settings in snippets, stored snapshots and documents; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import assess, extract, incremental, interpret, inventory
from ..schemas import LANGUAGES
from ..sources import repository, virtual
from ..sources.repository import Source
from ..workspace import Tables
from . import code_queries, document, pipeline  # noqa: F401  the first gives SQL that is used here
from .queries import _CHANGES, _CLASSIFIED, _DIAGNOSTICS, _STATUS, SQL, _changes, _diagnostics, _inventory, _query, _t


@_query(f"{_CLASSIFIED} SELECT relative_path FROM classified WHERE ignored")
def omitted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.omitted(_inventory(spark, sf_dir))


@_query(f"{_CHANGES} SELECT relative_path, change, CASE change WHEN 'added' THEN 0 WHEN 'changed' THEN 1 ELSE 2 END AS turn FROM changes WHERE change <> 'unchanged'")
def reprocessed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.reprocessed(_changes(spark, sf_dir))


@_query(f"{_CLASSIFIED} SELECT relative_path, sha256(concat(relative_path, '|', size, '|', coalesce(detected_language, 'null'), '|', type, '|', sha256(content))) AS content_hash FROM classified WHERE NOT ignored")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = virtual.files(spark, sf_dir)
    found = inventory.inventory(files).join(files.select("relative_path", "content"), "relative_path")
    return incremental.snapshot(found, "content").select("relative_path", "content_hash")


@_query(f"{_CLASSIFIED} SELECT relative_path, size AS size_bytes, sha256(concat(relative_path, '|', size, '|', coalesce(detected_language, 'null'), '|', type)) AS content_hash, detected_language, type AS file_type FROM classified WHERE NOT ignored")
def stored_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot written as JSON and read again."""
    path = f"{Tables(spark, 'snapshot').root}/snapshot.json"
    repository.write_snapshot_json(spark, incremental.snapshot(_inventory(spark, sf_dir)), path)
    return repository.read_snapshot(spark, path)


@_query(SQL["code_index"])
def stored_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole index written as a document with its manifest, and read again."""
    root = Tables(spark, "document").root
    files = virtual.code(spark, sf_dir).select("relative_path", "size", "content")
    result = pipeline.index(spark, files, f"{root}/tables", "code")
    document.write(spark, result, f"{root}/index.json", Source("code", sf_dir, "LOCAL_PATH"), "1")
    _, tables = document.read(spark, f"{root}/index.json")
    by = lambda name, key: tables[name].groupBy(F.col(key).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "kind", "n")
    return by("scopes", "kind").unionByName(by("entities", "kind")).unionByName(by("relationships", "kind")).unionByName(by("diagnostics", "severity"))


# parses with every status, over files of every language
_STATES = f"""{_CLASSIFIED},
states AS (SELECT doc_id, relative_path AS path, detected_language AS language, CASE doc_id % 6 {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATUS))} END AS status, doc_id % 4 < 2 AS has_tree
  FROM classified WHERE NOT ignored AND detected_language IS NOT NULL)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = virtual.files(spark, sf_dir), F.col("doc_id")
    found = inventory.inventory(rows).where("not ignored and detected_language is not null").select("relative_path", F.col("detected_language").alias("language"))
    status = F.element_at(F.array(*(F.lit(s) for s in _STATUS)), (n % 6 + 1).cast("int"))
    return rows.join(found, "relative_path").select(n, F.col("relative_path").alias("path"), "language", status.alias("status"), (n % 4 < 2).alias("has_tree"))


_READ = f"language IN ({', '.join(repr(x) for x in LANGUAGES)})"


@_query(f"""{_STATES}
SELECT path, CASE WHEN status = 'SUCCESS' AND has_tree THEN 'whole' ELSE 'degraded' END AS gate, '-' AS code FROM states WHERE {_READ} AND has_tree AND (status = 'SUCCESS' OR language = 'typescript')
UNION ALL SELECT path, 'warning', CASE WHEN language = 'typescript' AND has_tree THEN 'extract.typescript.degraded-syntax-tree' ELSE concat('extract.', language, '.syntax-tree-required') END
FROM states WHERE {_READ} AND NOT (status = 'SUCCESS' AND has_tree)""")
def extraction_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, warnings = extract.gates(_states(spark, sf_dir))
    gate = F.when(F.col("status") == "SUCCESS", "whole").otherwise("degraded")
    return reads.select("path", gate.alias("gate"), F.lit("-").alias("code")).unionByName(warnings.select(F.col("file_path").alias("path"), F.lit("warning").alias("gate"), "code"))


@_query(f"""{_STATES}
SELECT concat('diag:parse:', translate(path, '\\/ ', '::_'), ':', CAST(i AS VARCHAR)) AS id, CASE WHEN status IN ('SUCCESS', 'SKIPPED') THEN 'INFO' WHEN status = 'PARSE_ERROR' THEN 'ERROR' ELSE 'WARNING' END AS severity,
  'EXTRACTION' AS phase, concat('code.', CAST(i AS VARCHAR)) AS code, i = 1 AS fatal, path AS file_path FROM states, range(0, 2) t(i)""")
def parse_issue_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = lambda i: F.struct(F.lit(f"code.{i}").alias("code"), F.lit("said").alias("message"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(i == 1).alias("fatal"))
    rows = _states(spark, sf_dir).withColumns({"issues": F.array(issue(0), issue(1)), "parser_backend": F.lit("x")})
    return assess.parse_diagnostics(rows).select("id", "severity", "phase", "code", "fatal", "file_path")


@_query(f"""{_STATES}, d AS ({_DIAGNOSTICS})
SELECT file_path FROM d WHERE file_path IS NOT NULL AND (severity <> 'INFO' OR fatal)
UNION SELECT path FROM states WHERE status IN ('BACKEND_UNAVAILABLE', 'UNSUPPORTED_LANGUAGE') OR (status = 'PARSE_ERROR' AND NOT has_tree)""")
def degraded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.degraded(_diagnostics(spark, sf_dir), _states(spark, sf_dir))


@_query(f"""{_STATES}, c AS (SELECT count(*) FILTER (status = 'PARSE_ERROR') AS errors, count(*) FILTER (status = 'PARSE_ERROR' AND has_tree) AS recoverable, count(*) FILTER (status = 'BACKEND_UNAVAILABLE') AS unavailable,
  count(*) FILTER (status = 'UNSUPPORTED_LANGUAGE') AS unsupported, (SELECT count(*) FROM classified WHERE ignored) AS ignored FROM states)
SELECT unnest(['recoverable', 'lost', 'unavailable', 'unsupported', 'ignored']) AS what, unnest([recoverable, errors - recoverable, unavailable, unsupported, ignored]) AS n FROM c""")
def assessment_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that the notes state, by what they are about."""
    one = assess.assess(_inventory(spark, sf_dir), _states(spark, sf_dir), _diagnostics(spark, sf_dir), listed=False)
    note = F.col("note")
    what = F.when(note.contains("left a syntax tree"), "recoverable").when(note.contains("left none"), "lost").when(note.contains("whose parser"), "unavailable").when(note.contains("no parser knows"), "unsupported").when(note.contains("ignore rules"), "ignored")
    rows = one.select(F.explode("notes").alias("note")).where("note like '% file(s) %'")
    return rows.select(what.alias("what"), F.substring_index("note", " ", 1).cast("long").alias("n"))


@_query(f"""{_CLASSIFIED}
SELECT relative_path, replace(CASE WHEN contains(relative_path, '/java/') AND regexp_extract(relative_path, '^.*?/java/(.+)/[^/]*$', 1) <> '' THEN regexp_extract(relative_path, '^.*?/java/(.+)/[^/]*$', 1)
  WHEN contains(relative_path, '/') THEN regexp_extract(relative_path, '^(.+)/[^/]*$', 1) ELSE 'default' END, '/', '.') AS package FROM classified""")
def packages_from_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.files(spark, sf_dir).select("relative_path", text.package_from_path(F.col("relative_path")).alias("package"))


# Settings of every language by part: key, value, and whether they tell a datastore
_SETTINGS = """made AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'yaml' WHEN 2 THEN 'properties' ELSE 'xml' END AS language,
  CASE p_partkey % 5 WHEN 0 THEN concat('"key', p_partkey, '": "mysql', p_size, '"') WHEN 1 THEN concat('key', p_partkey, ': value ', p_size) WHEN 2 THEN concat('key.', p_partkey, ' = jdbc:x', p_size)
    WHEN 3 THEN concat('<key', p_partkey, '>text ', p_size, '</key', p_partkey, '>') ELSE concat('key', p_partkey, '="at ', p_size, '" other="x"') END AS snippet,
  concat('key', CASE WHEN p_partkey % 5 = 2 THEN '.' ELSE '' END, p_partkey) AS key,
  concat(CASE p_partkey % 5 WHEN 0 THEN 'mysql' WHEN 1 THEN 'value ' WHEN 2 THEN 'jdbc:x' WHEN 3 THEN 'text ' ELSE 'at ' END, p_size) AS value FROM part)"""


@_query(f"WITH {_SETTINGS} SELECT k, key, value, k % 5 IN (0, 2) AS datastore FROM made")
def settings_of_every_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size, own = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 5
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    snippet = (
        F.when(own == 0, say('"key', k, '": "mysql', size, '"')).when(own == 1, say("key", k, ": value ", size)).when(own == 2, say("key.", k, " = jdbc:x", size))
        .when(own == 3, say("<key", k, ">text ", size, "</key", k, ">")).otherwise(say("key", k, '="at ', size, '" other="x"'))
    )
    language = F.when(own == 0, "json").when(own == 1, "yaml").when(own == 2, "properties").otherwise("xml")
    rows = _t(spark, sf_dir, "part").select(k.alias("k"), text.config_pair(language, snippet).alias("pair"))
    # a quoted value keeps its first quote where its snippet ends with one
    value = F.regexp_replace("pair.value", '^"', "")
    return rows.select("k", "pair.key", value.alias("value"), text.datastore_like(F.col("pair.key"), F.col("pair.value")).alias("datastore"))


# Annotations and what they say about an endpoint.
_VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "REQUEST", "MyGetMapping": "GET", "Get": "-"}


@_query(f"""WITH m AS (SELECT p_partkey AS k, CASE p_partkey % {len(_VERBS)} {" ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_VERBS.values()))} END AS method FROM part) SELECT k, method FROM m""")
def endpoint_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.element_at(F.array(*(F.lit(v) for v in _VERBS)), (k % len(_VERBS) + 1).cast("int"))
    found = interpret.endpoint_annotation(F.array(F.lit("Override"), name, F.lit("Other")))
    return _t(spark, sf_dir, "part").select(k.alias("k"), F.when(found.isNull(), "-").otherwise(text.http_method(found)).alias("method"))


@_query("""SELECT p_partkey AS k, concat('net.p', p_partkey, '.T', p_size) AS imported, concat('net.p', p_partkey, '.T', p_size, '.member') AS static_import, concat('run', p_partkey) AS method,
  concat('./lib/m', p_partkey) AS source, concat('Mark,a.b.Note', p_size) AS annotations, concat('C', p_size) AS qualified FROM part""")
def names_in_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return _t(spark, sf_dir, "part").select(
        k.alias("k"),
        text.java_import(say("import net.p", k, ".T", size, ";")).alias("imported"),
        text.java_import(say("import static net.p", k, ".T", size, ".member ;")).alias("static_import"),
        text.java_method_name(say("public int run", k, "(String a) { return go(a); }")).alias("method"),
        text.import_source(say("import { a, b } from './lib/m", k, "';")).alias("source"),
        F.array_join(text.annotations(say("@Mark @a.b.Note", size, "(x) class C")), ",").alias("annotations"),
        text.qualified_name(say("public final C", size)).alias("qualified"),
    )
