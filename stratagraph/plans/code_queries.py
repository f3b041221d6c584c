"""Registered queries that run the whole chain, parse, extract, interpret and infer, over a repository of code made of the driver's tables; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import extract, interpret, inventory, summaries, topology
from ..parse import run as parsing
from ..sources import virtual
from ..workspace import Tables
from . import pipeline
from .queries import _CRC32, SQL, _crc32, _query

_CODE = "WITH " + virtual.CODE_SQL.strip()

# imports in order: file, place of the statement, label, its language
_IMPORTS = f"""{_CODE},
imports AS (
  SELECT n, path, root, language, 1 AS pos, concat(CASE WHEN (n + 4) % 20 = 0 THEN 'app.g0' ELSE concat('app.g', (n + 4) % 5, '.h', (n + 4) % 3) END, '.T', n + 4,
    CASE (n + 4) % 7 {" ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(virtual.SUFFIXES))} END) AS label FROM code WHERE k = 0
  UNION ALL SELECT n, path, root, language, 2, 'java.util.List' FROM code WHERE k = 0
  UNION ALL SELECT n, path, root, language, i + 1, concat('lib-', n % 3, '-', i) FROM code, range(0, {virtual.LIBRARIES}) t(i) WHERE k = 1
  UNION ALL SELECT n, path, root, language, 10, concat('../web', (n + 4) % 8, '/c', n + 4) FROM code WHERE k = 1
  UNION ALL SELECT n, path, root, language, 11, concat('../web', (n + 4) % 8, '/c', n + 12) FROM code WHERE k = 1
  UNION ALL SELECT n, path, root, language, 12, concat('./c', n + 8) FROM code WHERE k = 1
),
outside AS (SELECT label, language, min(path) AS path FROM imports GROUP BY 1, 2),
tables AS (
  SELECT n, path, concat('t', n) AS name, true AS made FROM code WHERE k = 2 UNION ALL SELECT n, path, concat('t', n + 4), false FROM code WHERE k = 2
  UNION ALL SELECT n, path, concat('shared', n % 3), false FROM code WHERE k = 2 UNION ALL SELECT n, path, concat('log', n % 5), false FROM code WHERE k = 2
),
settings AS (
  SELECT path, language, 'server.name' AS key, 'CONFIG_ARTIFACT' AS kind, CAST([] AS VARCHAR[]) AS targets FROM code WHERE language = 'properties'
  UNION ALL SELECT path, language, 'spring.datasource.url', 'DATASTORE', [concat('jdbc:postgresql://db', n % 7, ':5432/app'), concat('db', n % 7, ':5432')] FROM code WHERE language = 'properties'
  UNION ALL SELECT path, language, 'api.url', 'CONFIG_ARTIFACT', [concat('https://api', n % 5, '.example.org/v1')] FROM code WHERE language = 'properties'
  UNION ALL SELECT path, language, 'name', 'CONFIG_ARTIFACT', [] FROM code WHERE language = 'json'
  UNION ALL SELECT path, language, 'baseUrl', 'CONFIG_ARTIFACT', [concat('https://api', n % 5, '.example.org/v1')] FROM code WHERE language = 'json'
),
targets AS (SELECT path, language, key, CASE WHEN kind = 'DATASTORE' THEN 'DATASTORE' ELSE 'EXTERNAL_SYSTEM' END AS kind, unnest(targets) AS target FROM settings),
entities AS (
  SELECT path, 'MODULE' AS kind, 'OBSERVED' AS origin, path AS name, regexp_extract(path, '[^/]+$') AS display_name FROM code
  UNION ALL SELECT path, 'MODULE', 'INFERRED', label, CASE WHEN language = 'java' THEN regexp_extract(label, '[^.]+$') ELSE regexp_extract(label, '[^/]+$') END FROM outside
  UNION ALL SELECT path, 'CLASS', 'OBSERVED', type, type FROM code WHERE k = 0
  UNION ALL SELECT path, 'FUNCTION', 'OBSERVED', 'GetMapping', 'GetMapping()' FROM code WHERE k = 0
  UNION ALL SELECT path, 'FUNCTION', 'OBSERVED', concat('run', n), concat('run', n, '(int a)') FROM code WHERE k = 0
  UNION ALL SELECT path, 'CLASS', 'OBSERVED', concat('View', n), concat('View', n) FROM code WHERE k = 1
  UNION ALL SELECT path, 'FUNCTION', 'OBSERVED', concat(f, n), concat(f, n) FROM code, unnest(['bootstrap', 'call']) t(f) WHERE k = 1
  UNION ALL SELECT min(path), 'DATASTORE', CASE WHEN arg_min(made, path) THEN 'OBSERVED' ELSE 'INFERRED' END, name, name FROM tables GROUP BY name
  UNION ALL SELECT path, kind, 'OBSERVED', key, CASE WHEN kind = 'DATASTORE' THEN concat(path, '#', key) ELSE key END FROM settings
  UNION ALL SELECT min(path), arg_min(kind, path), 'INFERRED', target, target FROM targets GROUP BY language, target
)"""


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, extract.Facts, Tables]:
    """(inventory, parses, facts, tables): parsed once into written tables, which all that follows reads."""
    tables = Tables(spark, "code")
    files = virtual.code(spark, sf_dir).select("relative_path", "size", "content")
    parses, nodes = parsing.split(tables.keep(parsing.parse(files), "parsed"))
    facts = extract.extract(tables.keep(nodes, "nodes", "language"), parses)
    return inventory.inventory(files), parses, facts, tables


def _topology(spark: SparkSession, sf_dir: str) -> tuple[topology.Topology, extract.Facts]:
    found, _, facts, tables = _facts(spark, sf_dir)
    facts = extract.Facts(*(tables.keep(getattr(facts, n), n) for n in ("scopes", "entities", "relationships")), facts.diagnostics)
    return topology.infer(found, facts.scopes, facts.entities, facts.relationships), facts


def _path() -> F.Column:
    return F.get("source_refs", F.lit(0))["path"]


def _named(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with the names of their ends."""
    end = lambda c: entities.select(F.col("id").alias(f"{c}_entity_id"), F.col("name").alias(f"{c}_name"))
    return relationships.join(end("from"), "from_entity_id").join(end("to"), "to_entity_id")


@_query(f"{_CODE} SELECT path, language, 'SUCCESS' AS status, 'plain-scanner' AS parser_backend FROM code")
def code_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parses, _, _ = _facts(spark, sf_dir)
    return parses.select("path", "language", "status", "parser_backend")


@_query(f"{_IMPORTS} SELECT path, kind, origin, name, display_name FROM entities")
def code_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, facts, _ = _facts(spark, sf_dir)
    return facts.entities.select(_path().alias("path"), "kind", "origin", "name", "display_name")


_RELATIONS = f"""{_IMPORTS},
relations AS (
  SELECT 'DEPENDS_ON' AS kind, label, path AS from_name, label AS to_name FROM imports
  UNION ALL SELECT 'CONTAINS', 'contains', path, type FROM code WHERE k = 0
  UNION ALL SELECT 'CONTAINS', 'contains', path, f FROM code, unnest(['GetMapping', concat('run', n)]) t(f) WHERE k = 0
  UNION ALL SELECT 'CONTAINS', 'contains', path, f FROM code, unnest([concat('View', n), concat('bootstrap', n), concat('call', n)]) t(f) WHERE k = 1
  UNION ALL SELECT CASE WHEN made THEN 'CONTAINS' ELSE 'DEPENDS_ON' END, CASE WHEN made THEN 'contains' ELSE name END, path, name FROM tables
  UNION ALL SELECT 'CONTAINS', 'contains', path, key FROM settings
  UNION ALL SELECT 'DEPENDS_ON', target, key, target FROM targets
)"""


@_query(f"{_RELATIONS} SELECT kind, label, from_name, to_name, CAST(count(*) AS BIGINT) AS n FROM relations GROUP BY ALL")
def code_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, facts, tables = _facts(spark, sf_dir)
    entities = tables.keep(facts.entities, "entities")
    return _named(facts.relationships, entities).groupBy("kind", "label", "from_name", "to_name").agg(F.count("*").alias("n"))




@_query(f"""{_RELATIONS} SELECT (SELECT count(*) FROM code) AS files_visited, (SELECT count(*) FROM code) AS files_extracted,
  (SELECT string_agg(concat(language, '=', c), ',' ORDER BY language) FROM (SELECT language, count(*) AS c FROM code GROUP BY 1)) AS by_language,
  concat('SYNTAX_TREE=', (SELECT count(*) FROM code)) AS by_mode, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relations) AS relationships,
  (SELECT string_agg(concat(kind, '=', c), ',' ORDER BY kind) FROM (SELECT kind, count(*) AS c FROM entities GROUP BY 1)) AS entities_by_kind""")
def code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parses, facts, tables = _facts(spark, sf_dir)
    facts = extract.Facts(*(tables.keep(getattr(facts, n), n) for n in ("scopes", "entities", "relationships")), facts.diagnostics)
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    # one row each
    out = extract.summary(parses, facts).crossJoin(summaries.counts(facts.entities, F.col("kind"), "entities_by_kind"))
    return out.withColumns({c: shown(c) for c in ("by_language", "by_mode", "entities_by_kind")}).drop("scopes")


@_query(f"""{_IMPORTS},
roles AS (
  SELECT 'SERVICE' AS kind, type AS name, concat(type, ' service') AS display_name, 'interpreted-as-service' AS label FROM code WHERE k = 0 AND (n % 3 = 0 OR regexp_matches(type, '(Service|Manager)$'))
  UNION ALL SELECT 'PERSISTENCE_ADAPTER', type, concat(type, ' persistence adapter'), 'interpreted-as-persistence-adapter' FROM code WHERE k = 0 AND regexp_matches(type, '(Repository|Dao)$')
  UNION ALL SELECT 'UI_MODULE', concat('View', n), concat('View', n, ' ui module'), 'interpreted-as-ui-module' FROM code WHERE k = 1 AND n % 3 = 0
  UNION ALL SELECT 'SERVICE', concat('View', n), concat('View', n, ' service'), 'interpreted-as-service' FROM code WHERE k = 1 AND n % 3 = 1
  UNION ALL SELECT 'STARTUP_POINT', concat('bootstrap', n), concat('bootstrap', n, ' startup point'), 'interpreted-as-startup-point' FROM code WHERE k = 1
)
SELECT 'USES' AS link, kind, name, display_name, label, name AS from_name FROM roles
UNION ALL SELECT 'EXPOSES', 'ENDPOINT', concat('GET /r', n), concat('GetMapping() endpoint GET /r', n), concat('GET /r', n), type FROM code WHERE k = 0""")
def code_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, facts, tables = _facts(spark, sf_dir)
    entities = tables.keep(facts.entities, "entities")
    roles, links = interpret.interpret(entities)
    ends = entities.select(F.col("id").alias("from_entity_id"), F.col("name").alias("from_name"))
    links = links.select(F.col("kind").alias("link"), "label", "from_entity_id", F.col("to_entity_id").alias("id")).join(ends, "from_entity_id")
    return roles.select("id", "kind", "name", "display_name").join(links, "id").select("link", "kind", "name", "display_name", "label", "from_name")


# packages with the file whose reference they carry, ancestors with that of the first of their nearest stated descendants
_PACKAGES = f"""{_IMPORTS},
stated AS (SELECT package AS name, min(path) AS ref FROM code WHERE k = 0 GROUP BY 1),
up AS (SELECT array_to_string(list_slice(p, 1, i), '.') AS name, len(p) - i AS far, ref FROM (SELECT string_split(name, '.') AS p, ref, unnest(range(1, len(string_split(name, '.')) + 1)) AS i FROM stated)),
packages AS (SELECT name, arg_min(ref, (far, ref)) AS ref, CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)[.][^.]*$', 1) END AS parent FROM up GROUP BY name),
placed AS (SELECT p.name, p.parent, c.root FROM packages p JOIN code c ON c.path = p.ref),
modules AS (SELECT e.name, e.path, c.root, s.name AS package FROM entities e JOIN code c ON c.path = e.path LEFT JOIN stated s ON s.ref = e.path WHERE e.kind = 'MODULE')"""


def _edges(spark: SparkSession, sf_dir: str, *tags: str) -> DataFrame:
    shape, facts = _topology(spark, sf_dir)
    named = facts.entities.select("id", "name").unionByName(shape.entities.select("id", "name"))
    rows = shape.relationships.withColumn("rollup", F.get_json_object("metadata", "$.rollup")).where(F.col("rollup").isin(*tags))
    return _named(rows, named).select("rollup", "from_name", "to_name", "label")


@_query(f"""{_PACKAGES}
SELECT 'package-subpackage' AS rollup, parent AS from_name, name AS to_name, name AS label FROM packages WHERE parent IS NOT NULL
UNION ALL SELECT 'module-file', root, name, path FROM modules
UNION ALL SELECT 'module-package', a.root, a.name, a.name FROM placed a WHERE NOT EXISTS (SELECT 1 FROM placed b WHERE b.name = a.parent AND b.root = a.root)
UNION ALL SELECT 'package-file', package, name, name FROM modules WHERE package IS NOT NULL""")
def code_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, "package-subpackage", "module-file", "module-package", "package-file")


@_query(f"""{_PACKAGES},
resolved AS (
  SELECT i.path, i.pos, i.label, i.root, c.type AS target, c.path AS to_path, c.root AS to_root FROM imports i JOIN code c ON c.k = 0 AND i.label = concat(c.package, '.', c.type) WHERE i.language = 'java'
  UNION ALL SELECT i.path, i.pos, i.label, i.root, c.path, c.path, c.root FROM imports i JOIN code c ON c.k = 1 AND c.path = concat(CASE WHEN i.label LIKE './%' THEN concat(i.root, substr(i.label, 2)) ELSE substr(i.label, 4) END, '.ts') WHERE i.language = 'typescript'
),
lifted AS (SELECT r.*, a.name AS a, b.name AS b FROM resolved r LEFT JOIN stated a ON a.ref = r.path LEFT JOIN stated b ON b.ref = r.to_path)
SELECT 'file-internal' AS rollup, path AS from_name, target AS to_name, label FROM resolved
UNION ALL SELECT 'package-package', a, b, arg_min(label, (path, pos)) FROM lifted WHERE a <> b GROUP BY a, b
UNION ALL SELECT 'module-module', root, to_root, arg_min(label, (path, pos)) FROM lifted WHERE root <> to_root GROUP BY root, to_root""")
def code_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, "file-internal", "package-package", "module-module")


@_query(f"""{_PACKAGES},
folders AS (SELECT DISTINCT unnest(CASE WHEN k = 0 THEN ['src', regexp_extract(root, '^src/[^/]+'), root, concat(root, '/app')] ELSE [root] END) AS name FROM code)
SELECT 'DIRECTORY' AS kind, name, regexp_extract(name, '[^/]+$') AS display_name, CASE WHEN contains(name, '/') THEN regexp_extract(name, '^(.*)/[^/]*$', 1) ELSE '-' END AS parent FROM folders
UNION ALL SELECT DISTINCT 'MODULE', root, regexp_extract(root, '[^/]+$'), CASE WHEN contains(root, '/') THEN regexp_extract(root, '^(.*)/[^/]*$', 1) ELSE '-' END FROM code
UNION ALL SELECT 'PACKAGE', name, regexp_extract(name, '[^.]+$'), coalesce(parent, '-') FROM packages""")
def code_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape, _ = _topology(spark, sf_dir)
    above = shape.scopes.select(F.col("id").alias("parent_scope_id"), F.col("name").alias("parent"))
    return shape.scopes.join(above, "parent_scope_id", "left").select("kind", "name", "display_name", F.coalesce("parent", F.lit("-")).alias("parent"))


@_query(f"""{_IMPORTS}, {_CRC32},
files AS (SELECT path, concat('entity:file:', format('{{:x}}', {_crc32("path")})) AS file_id, concat('scope:file:', format('{{:x}}', {_crc32("path")})) AS scope_id FROM code, crc),
ends AS (SELECT i.path, f.file_id, f.scope_id, i.label, concat('entity:external:', i.language, ':', format('{{:x}}', {_crc32("i.label")})) AS target_id FROM imports i JOIN files f ON f.path = i.path, crc)
SELECT path, file_id, scope_id, label, target_id, concat('rel:depends-on:', format('{{:x}}', {_crc32("concat(file_id, ':', target_id, ':', label)")})) AS relationship_id FROM ends, crc""")
def code_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, facts, tables = _facts(spark, sf_dir)
    entities = tables.keep(facts.entities, "entities")
    files = entities.where("kind = 'MODULE' and origin = 'OBSERVED'").select(F.col("id").alias("file_id"), F.col("name").alias("path"), "scope_id")
    links = facts.relationships.where("kind = 'DEPENDS_ON'").select(F.col("id").alias("relationship_id"), F.col("from_entity_id").alias("file_id"), F.col("to_entity_id").alias("target_id"), "label")
    imports = links.join(files, "file_id").join(entities.where("kind = 'MODULE'").select(F.col("id").alias("target_id")), "target_id")
    # as the SQL states them: what tells ids of one CRC32 apart is left out
    return imports.select("path", "label", *(ids.plain(F.col(c)).alias(c) for c in ("file_id", "scope_id", "target_id", "relationship_id")))


# all that a whole index holds, by kind
_INDEXED = f"""WITH scopes AS ({SQL["code_scopes"]}), inside AS ({SQL["code_containment"]}), depends AS ({SQL["code_dependencies"]}), roles AS ({SQL["code_roles"]}),
facts AS ({SQL["code_entities"]}), links AS ({SQL["code_relationships"]}), files AS ({SQL["code_parses"]}),
rows AS (
  SELECT 'scopes' AS part, kind, count(*) AS n FROM scopes GROUP BY ALL UNION ALL SELECT 'scopes', 'FILE', count(*) FROM files UNION ALL SELECT 'scopes', 'REPOSITORY', 1
  UNION ALL SELECT 'entities', kind, count(*) FROM facts GROUP BY ALL UNION ALL SELECT 'entities', kind, count(*) FROM roles GROUP BY ALL
  UNION ALL SELECT 'entities', 'MODULE', count(*) FROM scopes WHERE kind IN ('MODULE', 'PACKAGE') UNION ALL SELECT 'entities', 'MODULE', 1
  UNION ALL SELECT 'relationships', kind, sum(n) FROM links GROUP BY ALL UNION ALL SELECT 'relationships', link, count(*) FROM roles GROUP BY ALL
  UNION ALL SELECT 'relationships', 'CONTAINS', count(*) FROM inside UNION ALL SELECT 'relationships', 'USES', count(*) FROM depends
  UNION ALL SELECT 'diagnostics', 'INFO', 1
)"""


@_query(f"{_INDEXED} SELECT part, kind, CAST(sum(n) AS BIGINT) AS n FROM rows GROUP BY ALL")
def code_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole index, assembled and validated."""
    files = virtual.code(spark, sf_dir).select("relative_path", "size", "content")
    result = pipeline.index(spark, files, Tables(spark, "index").root, "code")
    pipeline.validate(result)
    by = lambda name, key: getattr(result, name).groupBy(F.col(key).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "kind", "n")
    return by("scopes", "kind").unionByName(by("entities", "kind")).unionByName(by("relationships", "kind")).unionByName(by("diagnostics", "severity"))


@_query(f"""{_INDEXED}
SELECT 'parse' AS stage, 'by_status' AS what, 'SUCCESS' AS key, CAST(count(*) AS BIGINT) AS n FROM files UNION ALL SELECT 'parse', 'by_language', language, count(*) FROM files GROUP BY ALL
UNION ALL SELECT 'interpretation', 'entities_by_kind', kind, count(*) FROM roles GROUP BY ALL UNION ALL SELECT 'interpretation', 'relationships_by_kind', link, count(*) FROM roles GROUP BY ALL
UNION ALL SELECT 'interpretation', 'matches_by_rule', CASE WHEN from_name LIKE 'T%' THEN 'java-backend-high-value' ELSE 'typescript-frontend-high-value' END, 2 * count(*) FROM roles GROUP BY ALL
UNION ALL SELECT 'topology', 'scopes_by_kind', kind, count(*) FROM scopes GROUP BY ALL
UNION ALL SELECT 'topology', 'entities_by_kind', 'MODULE', count(*) FROM scopes WHERE kind IN ('MODULE', 'PACKAGE')
UNION ALL SELECT 'topology', 'relationships_by_kind', 'CONTAINS', count(*) FROM inside UNION ALL SELECT 'topology', 'relationships_by_kind', 'USES', count(*) FROM depends""")
def code_stage_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, parses, facts, tables = _facts(spark, sf_dir)
    facts = extract.Facts(*(tables.keep(getattr(facts, n), n) for n in ("scopes", "entities", "relationships")), facts.diagnostics)
    # written once, as every summary below reads them
    roles, links = (tables.keep(f, n) for f, n in zip(interpret.interpret(facts.entities), ("roles", "links")))
    shape = topology.infer(found, facts.scopes, facts.entities, facts.relationships)
    shape = topology.Topology(*(tables.keep(getattr(shape, n), f"shape-{n}") for n in ("scopes", "entities", "relationships")))
    stages = {"parse": summaries.parse_summary(parses), "interpretation": summaries.interpretation_summary(roles, links), "topology": summaries.topology_summary(shape.scopes, shape.entities, shape.relationships)}
    out = None
    for stage, one in stages.items():
        for what in [c for c in one.columns if "_by_" in c or c.startswith("by_")]:
            rows = one.select(F.lit(stage).alias("stage"), F.lit(what).alias("what"), F.explode(what).alias("key", "n"))
            rows = rows.withColumn("n", F.col("n").cast("long"))
            out = rows if out is None else out.unionByName(rows)
    return out
