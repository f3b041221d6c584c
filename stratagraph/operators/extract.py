"""Structural extraction: syntax nodes -> scopes, entities, relationships and diagnostics.

Every fact carries ``ord`` (file, phase, node, position), the order of emission
that first-wins rules refer to; nothing depends on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, naming, paths, text
from . import tree
from .dedup import first_wins

# The node types that each language's facts come from.
JAVA_TYPES = ["class_declaration", "interface_declaration", "enum_declaration", "record_declaration"]
JAVA_METHODS = ["method_declaration", "constructor_declaration"]
JAVA_ANNOTATIONS = ["marker_annotation", "annotation"]
SQL_NODES = ["statement", "create_table_statement", "insert_statement", "update_statement", "delete_statement", "select_statement", "truncate_statement"]
CONFIG_NODES = {"json": ["pair"], "yaml": ["block_mapping_pair", "flow_pair"], "properties": ["property"], "xml": ["element", "attribute"]}
CONFIG = list(CONFIG_NODES)

ENTITY = ["id", "kind", "origin", "name", "display_name", "scope_id", "source_refs", "metadata", "language", "labels", "qualified_name", "ord"]
RELATION = ["id", "kind", "from_entity_id", "to_entity_id", "label", "source_refs", "metadata", "ord"]
SCOPE = ["id", "kind", "name", "display_name", "parent_scope_id", "source_refs", "metadata", "ord"]


@dataclass(frozen=True)
class Found:
    """What one extractor gives, in parts."""

    scopes: list[DataFrame]
    entities: list[DataFrame]
    relationships: list[DataFrame]


#: nodes of a group of languages, parses that extraction reads of them -> facts
Extractor = Callable[[DataFrame, DataFrame], Found]


@dataclass(frozen=True)
class Facts:
    scopes: DataFrame
    entities: DataFrame
    relationships: DataFrame
    diagnostics: DataFrame


def text_map(**values: Column | str | None) -> Column:
    """A string map without its null values."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")


def source_ref(path: Column, line: Column | None = None, snippet: Column | None = None, **metadata: Column | str | None) -> Column:
    none = F.lit(None)
    at = none.cast("int") if line is None else line.cast("int")
    own = none.cast("string") if snippet is None else snippet
    return F.struct(path.alias("path"), at.alias("start_line"), at.alias("end_line"), own.alias("snippet"), text_map(**metadata).alias("metadata"))


def order(path: Column, phase: int, pre: Column | int = 0, pos: Column | int = 0) -> Column:
    col = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(path.alias("file"), F.lit(phase).alias("phase"), col(pre).alias("pre"), col(pos).alias("pos"))


def entity(rows: DataFrame, id: Column, kind: Column | str, origin: str, name: Column, display: Column, scope: Column | None, ref: Column, metadata: Column, language: Column | str, ord: Column, labels: Column | None = None, qualified: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("string")
    values = [id, lit(kind), F.lit(origin), name, display, none if scope is None else scope, F.array(ref), F.to_json(metadata), lit(language), F.array().cast("array<string>") if labels is None else labels, none if qualified is None else qualified, ord]
    return rows.select(*(v.alias(n) for v, n in zip(values, ENTITY)))


def relation(rows: DataFrame, prefix: str, kind: str, source: Column, target: Column, label: Column, ref: Column, metadata: Column, ord: Column) -> DataFrame:
    values = [ids.relationship_id(prefix, source, target, label), F.lit(kind), source, target, label, F.array(ref), F.to_json(metadata), ord]
    return rows.select(*(v.alias(n) for v, n in zip(values, RELATION)))


def contains(rows: DataFrame, source: Column, target: Column, ref: Column, ord: Column) -> DataFrame:
    return relation(rows, "contains", "CONTAINS", source, target, F.lit("contains"), ref, F.struct(), ord)


def depends(rows: DataFrame, source: Column, target: Column, label: Column, ref: Column, language: Column | str, ord: Column) -> DataFrame:
    lit = language if isinstance(language, Column) else F.lit(language)
    return relation(rows, "depends-on", "DEPENDS_ON", source, target, label, ref, F.struct(lit.alias("language")), ord)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _labels(above: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """``above`` with the distinct @names in its subtree's nodes of the types, in pre-order, as ``labels``."""
    found = tree.descendants(above.select("path", "pre", "last"), nodes.select("path", "pre", "type", "text"), types)
    own = found.groupBy("path", "pre").agg(F.array_sort(F.collect_list(F.struct("d_pre", text.annotations(F.col("d_text")).alias("names")))).alias("all"))
    own = own.select("path", "pre", F.array_distinct(F.flatten(F.transform("all", lambda x: x.names))).alias("labels"))
    return above.join(own, ["path", "pre"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def gates(parses: DataFrame, languages: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Parses that extraction reads, and its warnings; only TypeScript goes on with a tree that has errors. Other ``languages`` than the default ones need a tree without errors."""
    lang, tree_there = F.col("language"), F.col("has_tree")
    good = (F.col("status") == "SUCCESS") & tree_there
    supported = lang.isin(*(languages or list(EXTRACTORS)))
    degraded = (lang == "typescript") & tree_there & ~good
    reads = parses.where(supported & (good | degraded))
    code = F.when(degraded, F.lit("extract.typescript.degraded-syntax-tree")).otherwise(F.concat(F.lit("extract."), lang, F.lit(".syntax-tree-required")))
    whole = F.concat(F.lit("No facts were taken from this "), lang, F.lit(" file: its parse gave no whole syntax tree."))
    message = F.when(degraded, F.lit("Facts were taken from a typescript syntax tree that has errors.")).otherwise(whole)
    path, none = F.col("path"), F.lit(None).cast("string")
    warned = parses.where(supported & ~good).select("path", "language", "status", code.alias("code"), message.alias("message"))
    warnings = warned.select(
        F.concat(F.lit("diag:extract:"), ids.stable_token(F.concat_ws(":", path, "code", "message"))).alias("id"),
        F.lit("WARNING").alias("severity"),
        F.lit("EXTRACTION").alias("phase"),
        "code",
        "message",
        F.lit(False).alias("fatal"),
        path.alias("file_path"),
        none.alias("scope_id"),
        none.alias("entity_id"),
        F.array(source_ref(path, language=lang)).alias("source_refs"),
        F.to_json(F.struct(F.col("status").alias("parseStatus"))).alias("metadata"),
    )
    return reads, warnings


def _files(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File scopes and file modules, which every language has."""
    path, lang = F.col("path"), F.col("language")
    shown = naming.scope_display_name(F.lit("FILE"), path)
    folder = paths.parent(path)
    parent = F.when(folder.isNull(), F.lit(ids.REPO_SCOPE)).otherwise(ids.scope_id("directory", folder))
    scopes = reads.select(
        ids.scope_id("file", path).alias("id"),
        F.lit("FILE").alias("kind"),
        path.alias("name"),
        shown.alias("display_name"),
        parent.alias("parent_scope_id"),
        F.array(source_ref(path, scopeKind="file", displayName=shown)).alias("source_refs"),
        F.to_json(F.struct(path.alias("relativePath"), shown.alias("displayName"))).alias("metadata"),
        order(path, 0).alias("ord"),
    )
    shown = naming.entity_display_name(F.lit("MODULE"), path, lang)
    ref = source_ref(path, entityKind="module", language=lang, displayName=shown)
    meta = F.struct(lang.alias("language"), path.alias("relativePath"), shown.alias("displayName"))
    return scopes, entity(reads, ids.file_entity_id(path), "MODULE", "OBSERVED", path, shown, ids.scope_id("file", path), ref, meta, lang, order(path, 1))


def _imports(rows: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """rows (path, pre, line, text, label): modules outside, and the dependencies on them."""
    rows = rows.where(F.col("label").isNotNull() & (F.trim("label") != ""))
    path, line, label = F.col("path"), F.col("line"), F.col("label")
    shown = naming.entity_display_name(F.lit("MODULE"), label, F.lit(language))
    ref = source_ref(path, line, label, language=language, external="true", displayName=shown)
    meta = F.struct(F.lit(language).alias("language"), label.alias("qualifiedName"), F.lit(True).alias("external"), shown.alias("displayName"))
    target, at = ids.external_entity_id(language, label), order(path, 2, F.col("pre"))
    out = entity(rows, target, "MODULE", "INFERRED", label, shown, None, ref, meta, language, at, qualified=label)
    return out, depends(rows, ids.file_entity_id(path), target, label, source_ref(path, line, F.col("text"), language=language, kind="import"), language, at)


def _of(nodes: DataFrame, *languages: str) -> DataFrame:
    """The nodes of some languages: only these parts are read of a table that is partitioned by language."""
    return nodes.where(F.col("language").isin(*languages)).drop("language") if "language" in nodes.columns else nodes


def _java(nodes: DataFrame, reads: DataFrame) -> Found:
    path = F.col("path")
    own = _of(nodes, "java").join(reads.where("language = 'java'").select("path", "status"), "path").withColumn("line", F.col("start_line") + 1)
    stated = own.where("type = 'package_declaration'").groupBy("path").agg(text.qualified_name(F.min_by("text", "pre")).alias("stated"))
    files = reads.where("language = 'java'").select("path").join(stated, "path", "left")
    files = files.select("path", F.coalesce("stated", text.package_from_path(path)).alias("package"))
    package = F.col("package")
    above, shown = paths.parent(package, "."), naming.scope_display_name(F.lit("PACKAGE"), package)
    scopes = files.select(
        ids.scope_id("java-package", package).alias("id"),
        F.lit("PACKAGE").alias("kind"),
        package.alias("name"),
        shown.alias("display_name"),
        F.when(above.isNull(), F.lit(ids.REPO_SCOPE)).otherwise(ids.scope_id("java-package", above)).alias("parent_scope_id"),
        F.array(source_ref(path, scopeKind="package", language="java")).alias("source_refs"),
        F.to_json(F.struct(F.lit("java").alias("language"), package.alias("packageName"), shown.alias("displayName"), F.coalesce(above, F.lit("")).alias("parentPackageName"))).alias("metadata"),
        order(path, 0, 0, 1).alias("ord"),
    )
    imported, imports = _imports(own.where("type = 'import_declaration'").withColumn("label", text.java_import(F.col("text"))), "java")

    types = _labels(tree.first_descendant(own.where(F.col("type").isin(*JAVA_TYPES)), own, tree.NAMES, "simple"), own, JAVA_ANNOTATIONS)
    types = types.where(F.trim("simple") != "").join(files, "path")
    qualified = F.concat_ws(".", package, "simple")
    kind = F.when(F.col("type") == "interface_declaration", "INTERFACE").otherwise("CLASS")
    types = types.withColumns({"qualified": qualified, "e_kind": kind})
    qualified, line = F.col("qualified"), F.col("line")
    target = ids.scoped_entity_id("java", path, qualified, line)
    ref = source_ref(path, line, F.col("text"), language="java", kind=F.col("type"))
    mode = [F.col("status").alias("parseStatus"), F.lit("SYNTAX_TREE").alias("extractionMode")]
    meta = F.struct(F.lit("java").alias("language"), qualified.alias("qualifiedName"), package.alias("packageName"), F.col("labels").alias("annotations"), *mode)
    at = order(path, 3, F.col("pre"))
    typed = entity(types, target, F.col("e_kind"), "OBSERVED", F.col("simple"), naming.entity_display_name(F.col("e_kind"), qualified, F.lit("java")), ids.scope_id("java-package", package), ref, meta, "java", at, F.col("labels"), qualified)
    holds = contains(types, ids.file_entity_id(path), target, ref, at)

    methods = tree.first_descendant(own.where(F.col("type").isin(*JAVA_METHODS)), own, tree.NAMES, "declared")
    methods = _labels(tree.first_descendant(methods, own, ["formal_parameters", "parameters"], "params"), own, JAVA_ANNOTATIONS)
    blank = F.col("text").isNull() | (F.trim("text") == "")
    methods = methods.withColumn("simple", F.when(blank, F.col("declared")).otherwise(text.java_method_name(F.col("text")))).where(F.trim("simple") != "")
    params = F.coalesce("params", F.lit(""))
    target, at = ids.scoped_entity_id("java", path, F.col("simple"), line), order(path, 4, F.col("pre"))
    meta = F.struct(F.lit("java").alias("language"), params.alias("parameters"), F.col("labels").alias("annotations"), *mode)
    functions = entity(methods, target, "FUNCTION", "OBSERVED", F.col("simple"), F.concat("simple", text.strip(params)), ids.scope_id("file", path), ref, meta, "java", at, F.col("labels"))
    return Found([scopes], [imported, typed, functions], [imports, holds, contains(methods, ids.file_entity_id(path), target, ref, at)])


def _typescript(nodes: DataFrame, reads: DataFrame) -> Found:
    path, line = F.col("path"), F.col("line")
    own = _of(nodes, "typescript").join(reads.where("language = 'typescript'").select("path", "status"), "path").withColumn("line", F.col("start_line") + 1)
    imported, imports = _imports(own.where("type = 'import_statement'").withColumn("label", text.import_source(F.col("text"))), "typescript")
    arrows = tree.has_descendant(own.where("type = 'variable_declarator'"), own, "arrow_function")
    found = own.where(F.col("type").isin("class_declaration", "interface_declaration", "function_declaration")).unionByName(arrows)
    found = _labels(tree.first_descendant(found, own, tree.NAMES, "simple"), own, ["decorator"]).where(F.trim("simple") != "")
    type_ = F.col("type")
    kind = F.when(type_ == "class_declaration", "CLASS").when(type_ == "interface_declaration", "INTERFACE").otherwise("FUNCTION")
    phase = F.when(type_ == "class_declaration", 3).when(type_ == "interface_declaration", 4).when(type_ == "function_declaration", 5).otherwise(6)
    matched = F.when(type_ == "variable_declarator", "arrow_function").otherwise(type_)
    found = found.withColumns({"e_kind": kind, "matched": matched, "at": F.struct(path.alias("file"), phase.alias("phase"), F.col("pre").alias("pre"), F.lit(0).alias("pos"))})
    target = ids.scoped_entity_id("typescript", path, F.col("simple"), line)
    ref = source_ref(path, line, F.col("text"), language="typescript", kind=F.col("matched"))
    meta = F.struct(F.lit("typescript").alias("language"), F.col("labels").alias("decorators"), F.col("status").alias("parseStatus"), F.lit("SYNTAX_TREE").alias("extractionMode"))
    # the shown name is the name here, and the plain one is shown
    named = entity(found, target, F.col("e_kind"), "OBSERVED", naming.entity_display_name(F.col("e_kind"), F.col("simple"), F.lit("typescript")), F.col("simple"), ids.scope_id("file", path), ref, meta, "typescript", F.col("at"), F.col("labels"))
    return Found([], [imported, named], [imports, contains(found, ids.file_entity_id(path), target, ref, F.col("at"))])


def sql_tables(snippets: DataFrame) -> DataFrame:
    """snippets (path, pre, line, text) -> (path, pre, line, pos, table_name, defined), each definition once a file and each reference once a line.

    pos 0 is the definition of the node, references follow in the order of the rules.
    """
    made = snippets.select("path", "pre", "line", F.lit(0).alias("pos"), text.created_table(F.col("text")).alias("table_name"), F.lit(True).alias("defined")).where("table_name is not null")
    used = snippets.select("path", "pre", "line", F.posexplode(text.referenced_tables(F.col("text"))).alias("n", "table_name")).select("path", "pre", "line", (F.col("n") + 1).alias("pos"), "table_name", F.lit(False).alias("defined"))
    one = lambda rows, keys: rows.groupBy(*keys, F.lower("table_name").alias("k")).agg(F.min_by(F.struct(*rows.columns), F.struct("pre", "pos")).alias("f")).select("f.*")
    return one(made, ["path"]).unionByName(one(used, ["path", "line"]))


def _sql(nodes: DataFrame, reads: DataFrame) -> Found:
    path, line, table = F.col("path"), F.col("line"), F.col("table_name")
    own = _of(nodes, "sql").where(F.col("type").isin(*SQL_NODES)).join(reads.where("language = 'sql'").select("path", "status"), "path")
    own = own.withColumn("line", F.col("start_line") + 1).where(F.trim("text") != "")
    rows = sql_tables(own.select("path", "pre", "line", "text")).join(own.select("path", "pre", "text", "type", "status"), ["path", "pre"])
    target, at = ids.external_entity_id("sql-table", table), order(path, 2, F.col("pre"), F.col("pos"))
    ref = source_ref(path, line, F.col("text"), language="sql", kind=F.col("type"))
    meta = F.struct(F.lit("sql").alias("language"), table.alias("tableName"), F.col("status").alias("parseStatus"), F.lit("SYNTAX_TREE").alias("extractionMode"))
    made, used, file = rows.where("defined"), rows.where("not defined"), ids.file_entity_id(path)
    entities = [entity(made, target, "DATASTORE", "OBSERVED", table, table, ids.scope_id("file", path), ref, meta, "sql", at), entity(used, target, "DATASTORE", "INFERRED", table, table, None, ref, meta, "sql", at)]
    return Found([], entities, [contains(made, file, target, ref, at), depends(used, file, target, table, ref, "sql", at)])


def config_entries(snippets: DataFrame) -> DataFrame:
    """snippets (path, language, pre, line, text) -> (path, language, pre, line, snippet, key, value), a key once a line."""
    rows = snippets.withColumn("pair", text.config_pair(F.col("language"), F.col("text"))).where("pair is not null")
    rows = rows.select("path", "language", "pre", "line", text.sanitised(F.col("text")).alias("snippet"), "pair.key", "pair.value")
    return rows.groupBy("path", "line", "key").agg(F.min_by(F.struct(*rows.columns), "pre").alias("f")).select("f.*")


def _config(nodes: DataFrame, reads: DataFrame) -> Found:
    path, line, lang, key, value = (F.col(c) for c in ("path", "line", "language", "key", "value"))
    wanted = F.lit(False)
    for language, types in CONFIG_NODES.items():
        wanted = wanted | ((F.col("language") == language) & F.col("type").isin(*types))
    reads = reads.where(lang.isin(*CONFIG))
    own = _of(nodes, *CONFIG).join(reads.select("path", "language", "status"), "path").where(wanted).withColumn("line", F.col("start_line") + 1)
    rows = config_entries(own.select("path", "language", "pre", "line", "text")).join(reads.select("path", "status"), "path")
    kind = F.when(text.datastore_like(key, value), "DATASTORE").otherwise("CONFIG_ARTIFACT")
    rows = rows.withColumn("e_kind", kind)
    target, at = ids.scoped_entity_id(lang, path, key, line), order(path, 2, F.col("pre"))
    ref = source_ref(path, line, F.col("snippet"), language=lang, kind="config-entry")
    meta = F.struct(lang.alias("language"), key.alias("configKey"), value.alias("configValue"), F.col("status").alias("parseStatus"), F.lit("SYNTAX_TREE").alias("extractionMode"))
    shown = naming.entity_display_name(F.col("e_kind"), F.concat(path, F.lit("#"), key), lang)
    entries = entity(rows, target, F.col("e_kind"), "OBSERVED", key, shown, ids.scope_id("file", path), ref, meta, lang, at)
    holds = contains(rows, ids.file_entity_id(path), target, ref, at)
    outside = rows.select("*", F.posexplode(text.dependency_targets(key, value)).alias("pos", "target"))
    external, at = ids.external_entity_id(lang, F.col("target")), order(path, 2, F.col("pre"), F.col("pos") + 1)
    kind = F.when(F.col("e_kind") == "DATASTORE", "DATASTORE").otherwise("EXTERNAL_SYSTEM")
    meta = F.struct(lang.alias("language"), F.lit(True).alias("external"), key.alias("sourceConfigKey"))
    systems = entity(outside, external, kind, "INFERRED", F.col("target"), F.col("target"), None, ref, meta, lang, at)
    return Found([], [entries, systems], [holds, depends(outside, target, external, F.col("target"), ref, lang, at)])


#: The extractor of each language; those of several languages see the nodes of all of them at once.
EXTRACTORS: dict[str, Extractor] = {"java": _java, "typescript": _typescript, "sql": _sql, **{language: _config for language in CONFIG}}


def with_extractors(more: dict[str, Extractor], known: dict[str, Extractor] | None = None) -> dict[str, Extractor]:
    """The default extractors, or ``known`` ones, and more; the last one given for a language counts."""
    return {**(EXTRACTORS if known is None else known), **more}


def extract(nodes: DataFrame, parses: DataFrame, extractors: dict[str, Extractor] | None = None) -> Facts:
    """All facts, the first of each id, by the extractors of each language; files of other languages give none. ``nodes`` and ``parses`` are read several times: write them first."""
    extractors = EXTRACTORS if extractors is None else extractors
    reads, warnings = gates(parses, list(extractors) or [""])
    scopes, modules = _files(reads)
    found = []
    for extractor in dict.fromkeys(extractors.values()):
        languages = [x for x, own in extractors.items() if own is extractor]
        only = F.col("language").isin(*languages)
        found.append(extractor(nodes.where(only) if "language" in nodes.columns else nodes, reads.where(only)))
    every = lambda part: [frame for f in found for frame in getattr(f, part)]
    ord = F.col("ord")
    relationships = every("relationships") or [contains(modules, F.col("id"), F.col("id"), F.get("source_refs", F.lit(0)), ord).where(F.lit(False))]
    return Facts(
        first_wins(_union([scopes, *every("scopes")]), "id", ord),
        first_wins(_union([modules, *every("entities")]), "id", ord),
        first_wins(_union(relationships), "id", ord),
        warnings,
    )


def in_file(facts: DataFrame, path: Column | str) -> DataFrame:
    """Facts with any source reference to a file."""
    wanted = F.lit(path) if isinstance(path, str) else path
    return facts.where(F.exists("source_refs", lambda r: r["path"] == wanted))


def summary(parses: DataFrame, facts: Facts, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """One row: files visited and extracted, by language and by mode, and numbers of facts."""
    languages = list(EXTRACTORS if extractors is None else extractors)
    reads, _ = gates(parses, languages or [""])
    visited = parses.where(F.col("language").isin(*languages)).agg(F.count("*").alias("files_visited"))
    count = lambda key, name: reads.groupBy(key.alias("k")).agg(F.count("*").cast("int").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    # every file that is read gives its facts from a syntax tree
    counts = [
        reads.agg(F.count("*").alias("files_extracted")),
        count(F.col("language"), "by_language"),
        count(F.lit("SYNTAX_TREE"), "by_mode"),
        facts.entities.agg(F.count("*").alias("entities")),
        facts.relationships.agg(F.count("*").alias("relationships")),
        facts.scopes.agg(F.count("*").alias("scopes")),
    ]
    # one row each
    return reduce(lambda a, b: a.crossJoin(b), [visited, *counts])
