"""The registered queries: every operator class over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming, paths, text
from ..functions.ids import stable_token
from ..operators import assess, dedup, extract, incremental, interpret, inventory, topology, tree
from ..sources import virtual

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventory(virtual.files(spark, sf_dir))


_FILES = "WITH " + virtual.FILES_SQL.strip()
_CLASSIFIED = f"""{_FILES},
parts AS (
  SELECT *, lower(regexp_extract(relative_path, '[^/]*$')) AS fname,
    regexp_extract(lower(regexp_extract(relative_path, '[^/]*$')), '\\.([^.]+)$', 1) AS extension FROM files
),
classified AS (
  SELECT doc_id, relative_path, size, content, fname, extension,
    CASE WHEN regexp_matches(fname, '\\.(properties|yaml|yml|json|xml)$') OR fname LIKE 'build.gradle%' THEN 'config'
         WHEN extension = 'sql' THEN 'sql'
         WHEN extension IN ('java', 'kt', 'js', 'jsx', 'ts', 'tsx') THEN 'source'
         WHEN extension IN ('md', 'txt', 'rst') THEN 'documentation'
         WHEN extension = '' THEN 'unknown' ELSE extension END AS type,
    CASE extension WHEN 'java' THEN 'java' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript'
         WHEN 'tsx' THEN 'typescript' WHEN 'sql' THEN 'sql' WHEN 'json' THEN 'json' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml'
         WHEN 'properties' THEN 'properties' WHEN 'xml' THEN 'xml' END AS detected_language,
    regexp_matches(relative_path, '(^|/)(\\.git|\\.idea|\\.gradle|node_modules|target|build|dist|out|\\.DS_Store)(/|$)') AS ignored,
    lower(substr(content, 1, 16384)) AS head
  FROM parts
)"""
_MARKED = f"""{_CLASSIFIED},
told AS (
  SELECT *, (fname = 'pom.xml' OR fname LIKE 'build.gradle%') AS b, fname = 'package.json' AS n, regexp_matches(fname, '\\.(properties|yaml|yml)$') AS s FROM classified
),
marked AS (
  SELECT doc_id, relative_path, ignored, marker FROM (
    SELECT doc_id, relative_path, ignored, unnest([
      CASE WHEN b THEN 'build' END, CASE WHEN b AND (contains(head, 'spring-boot') OR contains(head, 'org.springframework')) THEN 'spring' END,
      CASE WHEN b AND contains(head, 'quarkus') THEN 'quarkus' END, CASE WHEN n THEN 'node' END,
      CASE WHEN n AND contains(head, '"react"') THEN 'react' END, CASE WHEN n AND contains(head, '"next"') THEN 'nextjs' END,
      CASE WHEN n AND contains(head, '"typescript"') THEN 'typescript' END,
      CASE WHEN s AND contains(head, 'spring.') THEN 'spring' END, CASE WHEN s AND contains(head, 'quarkus.') THEN 'quarkus' END,
      detected_language]) AS marker FROM told
  ) WHERE marker IS NOT NULL
)"""


@_query(f"{_CLASSIFIED} SELECT relative_path, size, extension, type, detected_language, ignored FROM classified")
def inventory_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir).drop("candidate_technology_markers")


@_query(f"""{_MARKED}
SELECT CAST(count(*) AS BIGINT) AS total_files, CAST(count(*) FILTER (ignored) AS BIGINT) AS ignored_files,
  CAST(count(*) FILTER (NOT ignored) AS BIGINT) AS indexed_files,
  (SELECT string_agg(l, ',' ORDER BY l) FROM (SELECT DISTINCT detected_language AS l FROM classified WHERE NOT ignored AND detected_language IS NOT NULL)) AS languages,
  (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT marker AS m FROM marked WHERE NOT ignored)) AS technologies
FROM classified""")
def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inventory.summary(_inventory(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("languages", "technologies")})


@_query(f"{_MARKED} SELECT DISTINCT relative_path, marker FROM marked")
def technology_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir).select("relative_path", F.explode("candidate_technology_markers").alias("marker"))


@_query(f"""{_CLASSIFIED}, split AS (SELECT string_split(relative_path, '/') AS p FROM classified WHERE NOT ignored),
dirs AS (SELECT DISTINCT list_slice(p, 1, i) AS d FROM (SELECT p, unnest(range(1, len(p))) AS i FROM split))
SELECT array_to_string(d, '/') AS path, CASE WHEN len(d) > 1 THEN array_to_string(list_slice(d, 1, len(d) - 1), '/') END AS parent, d[len(d)] AS display_name FROM dirs""")
def directory_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology.directories(_inventory(spark, sf_dir).where("not ignored"))
    return rows.withColumn("display_name", naming.scope_display_name(F.lit("DIRECTORY"), F.col("path")))


_ROOT = "CASE WHEN regexp_matches({0}, '^src/(main|test)/[^/]+') THEN regexp_extract({0}, '^src/(main|test)/[^/]+') ELSE regexp_extract({0}, '^[^/]*') END"


@_query(f"{_CLASSIFIED} SELECT {_ROOT.format('relative_path')} AS path, arg_min(detected_language, relative_path) AS language FROM (SELECT relative_path, coalesce(detected_language, '-') AS detected_language FROM classified WHERE NOT ignored) GROUP BY 1")
def module_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology.modules(_inventory(spark, sf_dir).where("not ignored"))
    return rows.withColumn("language", F.coalesce("language", F.lit("-")))


@_query("""WITH stated AS (SELECT concat(source, '.', lang, '.b', doc_id % 9) AS name, min(doc_id) AS ord FROM documents GROUP BY 1),
split AS (SELECT string_split(name, '.') AS p, ord FROM stated), up AS (SELECT array_to_string(list_slice(p, 1, i), '.') AS name, i < len(p) AS inferred, ord, i FROM (SELECT p, ord, unnest(range(1, len(p) + 1)) AS i FROM split))
SELECT name, regexp_extract(name, '^(.*)\\.[^.]*$', 1) AS parent, arg_min(ord, (CASE WHEN inferred THEN 1000000000000 ELSE 0 END) + ord) AS first_doc FROM up GROUP BY 1, 2""")
def package_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("."), "lang", F.lit(".b"), (F.col("doc_id") % 9).cast("string"))
    stated = docs.groupBy(name.alias("name")).agg(F.min("doc_id").alias("ord")).withColumns({"language": F.lit("java"), "refs": F.array("ord")})
    return topology.package_closure(stated).select("name", F.coalesce("parent", F.lit("")).alias("parent"), F.col("ord").alias("first_doc"))


@_query(f"""{_CLASSIFIED}
SELECT relative_path, regexp_extract(relative_path, '[^/]+$') AS file_name, concat('b', doc_id % 9) AS package_name, concat('k', doc_id % 7) AS member_name, concat('C', doc_id) AS class_name, concat('T', doc_id) AS ts_name FROM classified""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, path = F.col("doc_id"), F.col("relative_path")
    java, ts = F.lit("java"), F.lit("typescript")
    return virtual.files(spark, sf_dir).select(
        path,
        naming.scope_display_name(F.lit("FILE"), path).alias("file_name"),
        naming.scope_display_name(F.lit("PACKAGE"), F.concat(F.lit("com.example.b"), n % 9)).alias("package_name"),
        naming.entity_display_name(F.lit("CONFIG_ARTIFACT"), F.concat(path, F.lit("#k"), n % 7), F.lit("yaml")).alias("member_name"),
        naming.entity_display_name(F.lit("CLASS"), F.concat(F.lit("com.example.C"), n), java).alias("class_name"),
        naming.entity_display_name(F.lit("MODULE"), F.concat(F.lit("app.T"), n), ts).alias("ts_name"),
    )


@_query(f"{_CLASSIFIED} SELECT relative_path, sha256(concat(relative_path, '|', size, '|', coalesce(detected_language, 'null'), '|', type)) AS content_hash FROM classified WHERE NOT ignored")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.snapshot(_inventory(spark, sf_dir)).select("relative_path", "content_hash")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = virtual.files(spark, sf_dir)
    before = inventory.inventory(rows.where("doc_id % 13 <> 0"))
    after = inventory.inventory(rows.where("doc_id % 11 <> 0").withColumn("size", F.col("size") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)))
    return incremental.diff(incremental.snapshot(before), incremental.snapshot(after))


_CHANGES = f"""{_CLASSIFIED}, changes AS (SELECT relative_path, CASE WHEN doc_id % 13 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change
FROM classified WHERE NOT ignored AND NOT (doc_id % 13 = 0 AND doc_id % 11 = 0))"""


@_query(f"{_CHANGES} SELECT relative_path, change FROM changes")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@_query(f"""{_CHANGES} SELECT count(*) FILTER (change <> 'unchanged') > 0 AS incremental,
  concat((SELECT string_agg(relative_path, ',' ORDER BY relative_path) FROM changes WHERE change = 'added'), ',', (SELECT string_agg(relative_path, ',' ORDER BY relative_path) FROM changes WHERE change = 'changed')) AS parse_paths,
  (SELECT string_agg(relative_path, ',' ORDER BY relative_path) FROM changes WHERE change = 'removed') AS removed_paths,
  CAST(count(*) FILTER (change = 'added') AS BIGINT) AS added_count, CAST(count(*) FILTER (change = 'changed') AS BIGINT) AS changed_count,
  CAST(count(*) FILTER (change = 'removed') AS BIGINT) AS removed_count, CAST(count(*) FILTER (change = 'unchanged') AS BIGINT) AS unchanged_count,
  'reprocess-added-and-changed' AS strategy FROM changes""")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incremental.plan(_changes(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("parse_paths", "removed_paths")})


@_query("""WITH j AS (SELECT e.event_id, s.event_id AS near_event_id, row_number() OVER (PARTITION BY e.event_id ORDER BY s.ts DESC, s.event_id) AS r
FROM events e JOIN events s ON s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts WHERE e.event_type = 'error') SELECT event_id, near_event_id FROM j WHERE r = 1""")
def nearest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    points = events.where("event_type = 'error'").select("event_id", "ts", "user_id")
    out = interpret.nearest_preceding(points, events.where("event_type = 'signup'"), "user_id", "ts", ["event_id"], "event_id")
    return out.where("near_event_id is not null").select("event_id", "near_event_id")


@_query("SELECT source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_wins(_t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", F.col("doc_id"))


@_query("""SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(s_name, c_name) AS name, CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END AS first_stage
FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey""")
def precedence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    return dedup.precedence_union([c, s], "id").select("id", "name", F.col("position.stage").alias("first_stage"))


@_query("""WITH e AS (SELECT c_nationkey AS from_id, s_nationkey AS to_id, l_partkey AS label, row_number() OVER (PARTITION BY c_nationkey, s_nationkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS r
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey) SELECT from_id, to_id, label FROM e WHERE r = 1""")
def edge_lifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("label"))
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("from_id"))
    suppliers = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("to_id"))
    edges = lines.join(orders, "l_orderkey").join(customers, "o_custkey").join(suppliers, "l_suppkey").select("from_id", "to_id", "label", "l_orderkey", "l_linenumber")
    return dedup.distinct_edges(edges, F.struct("l_orderkey", "l_linenumber", "label")).select("from_id", "to_id", "label")


@_query("""WITH edges AS (SELECT p_partkey AS rel_id, concat('./m', p_partkey % 200) AS label, concat('src/app/m', p_partkey % 200) AS base FROM part),
modules AS (SELECT concat('src/app/m', s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN '.ts' WHEN 2 THEN '.tsx' WHEN 3 THEN '/index.ts' ELSE '/index.tsx' END) AS name, concat('f', s_suppkey) AS id FROM supplier
  UNION ALL SELECT concat('src/app/m', s_suppkey, '/index.tsx'), concat('g', s_suppkey) FROM supplier WHERE s_suppkey % 5 < 3),
types AS (SELECT concat('./m', s_suppkey) AS label, concat('t', s_suppkey) AS id FROM supplier WHERE s_suppkey % 17 = 0),
tries AS (SELECT rel_id, n, id FROM (SELECT rel_id, base, unnest(['', '.ts', '.tsx', '/index.ts', '/index.tsx']) AS s, unnest([0, 1, 2, 3, 4]) AS n FROM edges) JOIN modules ON name = concat(base, s)),
best AS (SELECT rel_id, arg_min(id, n) AS id FROM tries GROUP BY rel_id)
SELECT rel_id, coalesce(types.id, best.id) AS target_id FROM edges LEFT JOIN types USING (label) LEFT JOIN best USING (rel_id) WHERE coalesce(types.id, best.id) IS NOT NULL""")
def prioritised_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    edges = _t(spark, sf_dir, "part").select(k.alias("rel_id"), F.concat(F.lit("./m"), k % 200).alias("label"), F.lit("src/app/main.ts").alias("from_path"))
    s, sup = F.col("s_suppkey"), _t(spark, sf_dir, "supplier")
    base = F.concat(F.lit("src/app/m"), s)
    end = F.element_at(F.array(*(F.lit(x) for x in topology.SUFFIXES)), (s % 5 + 1).cast("int"))
    modules = sup.select(F.concat(base, end).alias("name"), F.concat(F.lit("f"), s).alias("id"))
    modules = modules.unionByName(sup.where("s_suppkey % 5 < 3").select(F.concat(base, F.lit("/index.tsx")).alias("name"), F.concat(F.lit("g"), s).alias("id")))
    types = sup.where("s_suppkey % 17 = 0").select(F.concat(F.lit("./m"), s).alias("qualified_name"), F.concat(F.lit("t"), s).alias("id"))
    return topology.default_resolver(edges, types, modules)


@_query(f"{_CLASSIFIED} SELECT {_ROOT.format('relative_path')} AS module, relative_path AS path, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS directory FROM classified WHERE NOT ignored")
def containment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _inventory(spark, sf_dir).where("not ignored").select(F.col("relative_path").alias("path"))
    roots = topology.modules(_inventory(spark, sf_dir).where("not ignored")).select(F.col("path").alias("module"))
    folders = topology.directories(_inventory(spark, sf_dir).where("not ignored")).select(F.col("path").alias("directory"))
    placed = files.withColumns({"module": paths.module_root(F.col("path")), "directory": paths.parent(F.col("path"))})
    return placed.join(roots, "module").join(folders, "directory").select("module", "path", "directory")


@_query("""WITH n AS (SELECT CAST(conv_id AS VARCHAR) AS path, CAST(turn AS INTEGER) AS pre, role AS type, text, CAST(max(turn) OVER (PARTITION BY conv_id) AS INTEGER) AS last FROM conversations)
SELECT a.path, a.pre, a.last - a.pre + 1 AS nodes, CAST(count(d.pre) AS BIGINT) AS found, arg_min(d.text, d.pre) AS first_text
FROM n a LEFT JOIN n d ON d.path = a.path AND d.pre BETWEEN a.pre AND a.last AND d.type = 'assistant' WHERE a.type = 'user' GROUP BY a.path, a.pre, a.last""")
def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("int").alias("pre"), F.col("role").alias("type"), "text")
    ends = rows.groupBy("path").agg(F.max("pre").alias("last"))
    nodes = rows.join(ends, "path")
    above = nodes.where("type = 'user'").select("path", "pre", "last")
    counts = tree.descendants(above, nodes.select("path", "pre", "type"), ["assistant"]).groupBy("path", "pre").agg(F.count("*").alias("found"))
    out = tree.first_descendant(above, nodes, ["assistant"], "first_text").join(counts, ["path", "pre"], "left")
    return out.select("path", "pre", tree.node_count(F.col("pre"), F.col("last")).alias("nodes"), F.coalesce("found", F.lit(0)).alias("found"), "first_text")


@_query("""SELECT event_id, regexp_extract(props, '"([A-Za-z0-9_.\\-/]+)"\\s*:\\s*(.+?)\\s*[}]$', 1) AS key, regexp_extract(props, '"([A-Za-z0-9_.\\-/]+)"\\s*:\\s*(.+?)\\s*[}]$', 2) AS value FROM events""")
def config_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_id", text.config_pair(F.lit("json"), F.regexp_replace("props", r"^\{", "")).alias("pair"))
    return rows.select("event_id", "pair.key", "pair.value")


@_query("""SELECT page_id, regexp_extract(html, '([A-Za-z0-9_.:-]+)\\s*=\\s*[''"]([^''"]+)[''"]', 1) AS key, regexp_extract(html, '([A-Za-z0-9_.:-]+)\\s*=\\s*[''"]([^''"]+)[''"]', 2) AS value FROM pages""")
def xml_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages")
    return pages.select("page_id", *(F.regexp_extract("html", text.XML_ATTRIBUTE, i).alias(n) for i, n in ((1, "key"), (2, "value"))))


@_query("""SELECT DISTINCT page_id, target FROM (SELECT page_id, unnest(list_concat(list_concat(regexp_extract_all(v, '(jdbc:[A-Za-z0-9:;_./?=&%-]+)', 1), regexp_extract_all(v, '(https?://[^\\s''"<>)]+)', 1)), regexp_extract_all(v, '\\b([A-Za-z0-9_.-]+:\\d{2,5})\\b', 1))) AS target
FROM (SELECT page_id, concat('jdbc:db//h', page_id, ':5432/x ', url) AS v FROM pages))""")
def dependency_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("jdbc:db//h"), "page_id", F.lit(":5432/x "), "url")
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(text.dependency_targets(F.lit("x"), value)).alias("target"))


_SNIPPET = "concat('select a from t', p_partkey % 97, ' join ', replace(p_brand, '#', '_'), ' on x; insert into log_', p_size, ' select 1; create table if not exists ', replace(p_brand, '#', '_'), '_copy (id int)')"


@_query(f"""WITH s AS (SELECT p_partkey, {_SNIPPET} AS t FROM part)
SELECT p_partkey, unnest(list_concat(regexp_extract_all(t, '(?i)\\b(?:insert\\s+into|update|delete\\s+from|truncate\\s+table)\\s+([A-Za-z_][\\w.$]*)', 1), regexp_extract_all(t, '(?i)\\b(?:from|join)\\s+([A-Za-z_][\\w.$]*)', 1))) AS table_name, false AS defined FROM s
UNION ALL SELECT p_partkey, regexp_extract(t, '(?i)\\bcreate\\s+table\\s+(?:if\\s+not\\s+exists\\s+)?([A-Za-z_][\\w.$]*)', 1), true FROM s""")
def sql_table_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit(0).alias("pre"), F.lit(1).alias("line"), F.expr(_SNIPPET).alias("text"))
    return extract.sql_tables(rows).select(F.col("path").cast("long").alias("p_partkey"), "table_name", "defined")


_ROLE_NAME = "concat(replace(p_name, ' ', ''), CASE p_partkey % 9 WHEN 0 THEN 'Service' WHEN 1 THEN 'Manager' WHEN 2 THEN 'Dao' WHEN 3 THEN 'Controller' WHEN 4 THEN 'Component' WHEN 5 THEN 'Api' WHEN 6 THEN 'Bootstrap' WHEN 7 THEN 'Mapper' ELSE 'Thing' END)"


@_query(f"""WITH n AS (SELECT p_partkey, {_ROLE_NAME} AS name, lower({_ROLE_NAME}) AS l, p_partkey % 4 = 0 AS a FROM part)
SELECT p_partkey, name, a OR regexp_matches(l, '(service|facade|manager)$') AS service, regexp_matches(l, '(repository|dao|mapper)$') AS persistence,
  regexp_matches(l, 'controller$') AS controller, regexp_matches(l, '(component|module)$') AS ui_module, regexp_matches(l, '(service|api|client)$') AS ts_service,
  CASE WHEN contains(l, 'bootstrap') OR l IN ('main', 'renderapp', 'startup') THEN 'name' WHEN p_partkey % 10 = 0 THEN 'path' END AS startup FROM n""")
def role_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, labels = F.col("name"), F.col("labels")
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.expr(_ROLE_NAME).alias("name"), F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("MyService"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    path = F.when(F.col("p_partkey") % 10 == 0, "app/main.ts").otherwise("app/x.ts")
    return rows.select(
        "p_partkey",
        "name",
        interpret.java_service(name, labels).alias("service"),
        interpret.java_persistence(name, labels).alias("persistence"),
        interpret.java_controller(name, labels).alias("controller"),
        interpret.ts_ui_module(name, labels).alias("ui_module"),
        interpret.ts_service(name, labels).alias("ts_service"),
        interpret.ts_startup(name, path).alias("startup"),
    )


@_query("""SELECT page_id, CASE WHEN r = '' THEN '/' ELSE substr(r, 2, length(r) - 2) END AS route FROM (SELECT page_id, regexp_extract(html, '"/[^''"]*"|''/[^''"]*''') AS r FROM pages)""")
def endpoint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", text.endpoint_path(F.col("html")).alias("route"))


_DIAGNOSTICS = "SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END AS severity, CASE WHEN event_type = 'signup' THEN 'SCAN' ELSE 'EXTRACTION' END AS phase, event_type = 'error' AND event_id % 1000 = 7 AS fatal, CASE WHEN event_id % 3 = 0 THEN concat('f', user_id) END AS file_path FROM events"


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    return _t(spark, sf_dir, "events").select(
        n,
        F.when(kind == "error", "ERROR").when(kind == "click", "WARNING").otherwise("INFO").alias("severity"),
        F.when(kind == "signup", "SCAN").otherwise("EXTRACTION").alias("phase"),
        ((kind == "error") & (n % 1000 == 7)).alias("fatal"),
        F.when(n % 3 == 0, F.concat(F.lit("f"), "user_id")).alias("file_path"),
    )


@_query(f"WITH d AS ({_DIAGNOSTICS}) SELECT severity, phase, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (fatal) AS BIGINT) AS fatal FROM d GROUP BY 1, 2")
def diagnostic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.diagnostic_counts(_diagnostics(spark, sf_dir))


_STATUS = ["SUCCESS", "SUCCESS", "PARSE_ERROR", "UNSUPPORTED_LANGUAGE", "BACKEND_UNAVAILABLE", "SKIPPED"]


@_query(f"""{_CLASSIFIED}, d AS ({_DIAGNOSTICS}), p AS (SELECT relative_path AS path, doc_id, CASE doc_id % 6 {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATUS))} END AS status, doc_id % 4 < 2 AS has_tree FROM classified WHERE NOT ignored),
bad AS (SELECT file_path FROM d WHERE file_path IS NOT NULL AND (severity <> 'INFO' OR fatal) UNION SELECT path FROM p WHERE status IN ('BACKEND_UNAVAILABLE', 'UNSUPPORTED_LANGUAGE') OR (status = 'PARSE_ERROR' AND NOT has_tree)),
c AS (SELECT (SELECT count(*) FILTER (fatal) FROM d) AS fatal, (SELECT count(*) FROM bad) AS degraded, (SELECT count(*) FILTER (status = 'PARSE_ERROR') FROM p) AS errors,
  (SELECT count(*) FILTER (status = 'PARSE_ERROR' AND has_tree) FROM p) AS recoverable, (SELECT count(*) FROM classified) AS total, (SELECT count(*) FILTER (ignored) FROM classified) AS ignored)
SELECT CASE WHEN fatal > 0 THEN 'FAILED' WHEN degraded > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS outcome, CASE WHEN fatal > 0 OR degraded > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness,
  CAST(total - ignored AS BIGINT) AS indexed, CAST(fatal AS BIGINT) AS fatal, CAST(degraded AS BIGINT) AS degraded, CAST(errors AS BIGINT) AS errors, CAST(recoverable AS BIGINT) AS recoverable, CAST(ignored AS BIGINT) AS ignored FROM c""")
def run_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = virtual.files(spark, sf_dir), F.col("doc_id")
    status = F.element_at(F.array(*(F.lit(s) for s in _STATUS)), (n % 6 + 1).cast("int"))
    found = inventory.inventory(rows)
    live = found.where("not ignored").select("relative_path")
    parses = rows.join(live, "relative_path", "left_semi").select(F.col("relative_path").alias("path"), status.alias("status"), (n % 4 < 2).alias("has_tree"))
    out = assess.assess(found, parses, _diagnostics(spark, sf_dir))
    return out.select("outcome", "completeness", "indexed", "fatal", "degraded", "errors", "recoverable", "ignored")


@_query("""WITH e AS (SELECT concat('c', c_custkey) AS id, CASE WHEN c_custkey % 100 = 0 THEN '' ELSE c_name END AS name FROM customer WHERE c_custkey % 10 <> 9),
r AS (SELECT concat('o', o_orderkey % 1000) AS id, concat('c', o_custkey) AS a, concat('c', o_custkey % 50) AS b FROM orders),
s AS (SELECT concat('c', s_suppkey) AS id, s_name AS name FROM supplier),
m AS (
  SELECT concat('entity name must be present for ', id) AS message FROM e WHERE name = ''
  UNION ALL SELECT concat('duplicate id within payload: ', id) FROM (SELECT id, count(*) AS n FROM (SELECT id FROM e UNION ALL SELECT id FROM r UNION ALL SELECT id FROM s) GROUP BY id) x, range(1, x.n) t(i) WHERE x.n > 1
  UNION ALL SELECT concat('relationship references missing fromEntityId: ', id) FROM r WHERE a NOT IN (SELECT id FROM e)
  UNION ALL SELECT concat('relationship references missing toEntityId: ', id) FROM r WHERE b NOT IN (SELECT id FROM e)
) SELECT message, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY message""")
def validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s, o = F.col("c_custkey"), F.col("s_suppkey"), F.col("o_custkey")
    entities = _t(spark, sf_dir, "customer").where("c_custkey % 10 <> 9").select(F.concat(F.lit("c"), k).alias("id"), F.when(k % 100 == 0, "").otherwise(F.col("c_name")).alias("name"))
    relations = _t(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey") % 1000).alias("id"), F.concat(F.lit("c"), o).alias("from_entity_id"), F.concat(F.lit("c"), o % 50).alias("to_entity_id"))
    scopes = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), s).alias("id"), F.col("s_name").alias("name"))
    return assess.violations(scopes, entities, relations).groupBy("message").agg(F.count("*").alias("n"))


# CRC-32 by its table of 256 remainders, over the bytes of a text
_CRC32 = """crc AS (SELECT list(r ORDER BY i) AS r FROM (
  SELECT i, list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS r FROM range(0, 256) t(i)))"""


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of a text, beside the table ``crc``."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda j: CAST(concat('0x', substr(hex(encode({text})), CAST(2 * j + 1 AS BIGINT), 2)) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(crc.r[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8)))"


@_query(f"{_FILES}, {_CRC32} SELECT doc_id, format('{{:x}}', {_crc32('relative_path')}) AS token FROM files, crc")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.files(spark, sf_dir).select("doc_id", stable_token(F.col("relative_path")).alias("token"))


@_query("""SELECT doc_id, sha256(text) AS payload_sha256, substr(sha256(text), 1, 12) AS export_id, CAST(octet_length(encode(text)) AS BIGINT) AS payload_size, CASE WHEN doc_id % 9 = 0 THEN 'do-not-import' ELSE 'safe-to-import' END AS recommendation FROM documents""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.export import manifest_columns

    docs = _t(spark, sf_dir, "documents").withColumn("outcome", F.when(F.col("doc_id") % 9 == 0, "FAILED").otherwise("SUCCESS"))
    return docs.select("doc_id", *manifest_columns(F.col("text"), F.col("outcome")))
