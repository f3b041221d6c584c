"""Topology: directories, modules and packages, containment, and dependencies lifted between levels.

All hierarchies come from exploding path prefixes, and all lookups are equi-joins
on derived keys; nothing iterates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, naming, paths
from .dedup import distinct_edges, first_wins
from .extract import order, source_ref

SUFFIXES = ["", ".ts", ".tsx", "/index.ts", "/index.tsx"]


@dataclass(frozen=True)
class Topology:
    scopes: DataFrame
    entities: DataFrame
    relationships: DataFrame


def directories(files: DataFrame) -> DataFrame:
    """files (relative_path) -> (path, parent) of every folder above a file."""
    found = files.select(F.explode(paths.prefixes(F.col("relative_path"))).alias("path")).distinct()
    return found.select("path", paths.parent(F.col("path")).alias("parent"))


def modules(files: DataFrame) -> DataFrame:
    """files (relative_path, detected_language) -> (path, language): source roots, with the first file's language."""
    path = F.col("relative_path")
    return files.groupBy(paths.module_root(path).alias("path")).agg(F.min_by("detected_language", path).alias("language"))


def package_closure(packages: DataFrame) -> DataFrame:
    """packages (name, language, refs, ord) -> with all ancestors and ``far``, the levels to the package whose refs and ord they take.

    An ancestor that is not stated itself takes those of the first of its nearest stated descendants. Of a package
    that is stated more than once the one with more refs counts, the first of equal ones.
    """
    most = F.struct((-F.size("refs")).alias("fewer"), "ord")
    stated = packages.groupBy("name", "language").agg(F.min_by("refs", most).alias("refs"), F.min("ord").alias("ord"))
    levels = F.size(F.split("name", r"\."))
    names = F.concat(paths.prefixes(F.col("name"), "."), F.array("name"))
    up = stated.select(F.posexplode(names).alias("n", "above"), levels.alias("levels"), "language", "refs", "ord")
    up = up.withColumn("far", F.col("levels") - 1 - F.col("n"))
    out = up.groupBy(F.col("above").alias("name"), "language").agg(F.min_by(F.struct("refs", "ord", "far"), F.struct("far", "ord")).alias("first"))
    return out.select("name", "language", "first.refs", "first.ord", "first.far", paths.parent(F.col("name"), ".").alias("parent"))


def _at(ord: Column, far: Column | int = 0) -> Column:
    """Place of an inferred fact: by levels, then as the fact that it comes from; all parts compare by their own types."""
    return F.struct((far if isinstance(far, Column) else F.lit(far)).cast("int").alias("far"), ord.alias("of"))


def _scopes(rows: DataFrame, kind: str, id: Column, name: Column, parent: Column, refs: Column, meta: Column, ord: Column) -> DataFrame:
    shown = naming.scope_display_name(F.lit(kind), name)
    return rows.select(id.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), shown.alias("display_name"), parent.alias("parent_scope_id"), refs.alias("source_refs"), F.to_json(meta).alias("metadata"), ord.alias("ord"))


def _edges(rows: DataFrame, prefix: str, kind: str, rollup: str, phase: int, ord: Column, **more: Column) -> DataFrame:
    """rows (from_id, to_id, label, source_refs) as relationships."""
    meta = F.struct(F.lit(rollup).alias("rollup"), *(v.alias(k) for k, v in more.items()))
    key = ids.relationship_id(prefix, F.col("from_id"), F.col("to_id"), F.coalesce("label", F.lit("")))
    at = F.struct(F.lit(phase).alias("phase"), ord.alias("at"))
    return rows.select(key.alias("id"), F.lit(kind).alias("kind"), F.col("from_id").alias("from_entity_id"), F.col("to_id").alias("to_entity_id"), "label", "source_refs", F.to_json(meta).alias("metadata"), at.alias("ord"))


def default_resolver(edges: DataFrame, types: DataFrame, file_modules: DataFrame) -> DataFrame:
    """edges (rel_id, label, from_path) -> (rel_id, target_id): a Java type by its qualified name, else a relative path as it is or with an ending."""
    by_type = edges.join(types.select(F.col("qualified_name").alias("label"), F.col("id").alias("type_id")), "label").select("rel_id", "type_id")
    relative = edges.where("label like './%' or label like '../%'").withColumn("base", paths.resolved(F.col("from_path"), F.col("label")))
    tries = relative.select("rel_id", F.posexplode(F.transform(F.array(*(F.lit(s) for s in SUFFIXES)), lambda s: F.concat("base", s))).alias("n", "path"))
    by_path = tries.join(file_modules.select(F.col("name").alias("path"), F.col("id").alias("file_id")), "path").groupBy("rel_id").agg(F.min_by("file_id", "n").alias("file_id"))
    found = edges.select("rel_id").join(by_type, "rel_id", "left").join(by_path, "rel_id", "left")
    return found.select("rel_id", F.coalesce("type_id", "file_id").alias("target_id")).where("target_id is not null")


def infer(inventory: DataFrame, scopes: DataFrame, entities: DataFrame, relationships: DataFrame, resolver=default_resolver) -> Topology:
    """Inventory and extracted facts -> inferred scopes, logical modules, containment and lifted dependencies."""
    files = inventory.where("not ignored").select("relative_path", "detected_language")
    path, none = F.col("path"), F.lit(None).cast("string")
    folder_id = lambda c: F.when(c.isNull(), F.lit(ids.REPO_SCOPE)).otherwise(ids.scope_id("directory", c))

    folders = _scopes(directories(files), "DIRECTORY", ids.scope_id("directory", path), path, folder_id(F.col("parent")), F.array(source_ref(path, scopeKind="directory")), F.struct(path.alias("relativePath")), _at(order(path, 0)))
    roots = modules(files)
    shown = naming.scope_display_name(F.lit("MODULE"), path)
    meta = F.struct(path.alias("relativePath"), F.col("language"), shown.alias("displayName"))
    module_scopes = _scopes(roots, "MODULE", ids.scope_id("module", path), path, folder_id(paths.parent(path)), F.array(source_ref(path, scopeKind="module", language=F.col("language"), displayName=shown)), meta, _at(order(path, 1)))

    stated = scopes.where("kind = 'PACKAGE'").select("name", F.get_json_object("metadata", "$.language").alias("language"), F.col("source_refs").alias("refs"), "ord")
    packages = package_closure(stated)
    name, lang = F.col("name"), F.col("language")
    package_id = lambda c: ids.scope_id(F.concat(lang, F.lit("-package")), c)
    parent = F.col("parent")
    shown = naming.scope_display_name(F.lit("PACKAGE"), name)
    meta = F.struct(lang, name.alias("packageName"), shown.alias("displayName"), parent.alias("parentPackageName"))
    package_scopes = _scopes(packages, "PACKAGE", package_id(name), name, F.when(parent.isNull(), F.lit(ids.REPO_SCOPE)).otherwise(package_id(parent)), F.col("refs"), meta, _at(F.col("ord"), F.col("far")))

    columns = ["id", "kind", "origin", "name", "display_name", "scope_id", "source_refs", "metadata", "ord"]
    shown = naming.entity_display_name(F.lit("MODULE"), path, lang)
    meta = F.struct(lang, F.lit("source-root").alias("logicalRole"), path.alias("relativePath"), shown.alias("displayName"))
    values = [ids.external_entity_id("logical-module", path), F.lit("MODULE"), F.lit("INFERRED"), path, shown, ids.scope_id("module", path), F.array(source_ref(path, entityKind="module", language=lang, displayName=shown)), F.to_json(meta), F.struct(F.lit(0).alias("phase"), _at(order(path, 0)).alias("at"))]
    module_entities = roots.select(*(v.alias(n) for v, n in zip(values, columns)))
    shown = naming.scope_display_name(F.lit("PACKAGE"), name)
    meta = F.struct(F.coalesce(lang, F.lit("unknown")).alias("language"), F.lit("package").alias("logicalRole"), shown.alias("displayName"))
    values = [ids.external_entity_id("logical-package", name), F.lit("MODULE"), F.lit("INFERRED"), name, shown, package_id(name), F.col("refs"), F.to_json(meta), F.struct(F.lit(1).alias("phase"), _at(F.col("ord"), F.col("far")).alias("at"))]
    package_entities = packages.select(*(v.alias(n) for v, n in zip(values, columns)))

    # containment
    package_entity = lambda c: ids.external_entity_id("logical-package", c)
    module_entity = lambda c: ids.external_entity_id("logical-module", c)
    nested = packages.where("parent is not null").select(package_entity(parent).alias("from_id"), package_entity(name).alias("to_id"), name.alias("label"), F.col("refs").alias("source_refs"), _at(F.col("ord"), F.col("far")).alias("ord"))
    own_files = entities.where("kind = 'MODULE'").select("id", "name", F.get("source_refs", F.lit(0))["path"].alias("path"), "source_refs", "ord").where("path is not null")
    live = roots.select(path.alias("root"))
    in_module = own_files.withColumn("root", paths.module_root(path)).join(live, "root").select(module_entity(F.col("root")).alias("from_id"), F.col("id").alias("to_id"), path.alias("label"), "source_refs", _at(F.col("ord")).alias("ord"))
    placed = packages.select("name", "language", "parent", "refs", "ord", "far", F.explode("refs").alias("ref")).withColumn("root", paths.module_root(F.col("ref.path"))).dropDuplicates(["name", "language", "root"])
    above = placed.select(F.col("name").alias("parent"), "language", "root")
    top = placed.join(live, "root").join(above, ["parent", "language", "root"], "left_anti")
    tops = top.select(module_entity(F.col("root")).alias("from_id"), package_entity(name).alias("to_id"), name.alias("label"), F.col("refs").alias("source_refs"), _at(F.col("ord"), F.col("far")).alias("ord"))
    # each file's package: the first stated scope with a reference to it
    file_package = stated.select("name", "ord", F.explode("refs").alias("ref")).groupBy(F.col("ref.path").alias("path")).agg(F.min_by("name", "ord").alias("package"))
    in_package = own_files.join(file_package, "path").select(package_entity(F.col("package")).alias("from_id"), F.col("id").alias("to_id"), F.col("name").alias("label"), "source_refs", _at(F.col("ord")).alias("ord"))

    # dependencies on what lies inside
    depends = relationships.where("kind = 'DEPENDS_ON'").select(F.col("id").alias("rel_id"), "from_entity_id", "label", F.col("source_refs").alias("rel_refs"), _at(F.col("ord")).alias("rel_ord"))
    depends = depends.join(own_files.select(F.col("id").alias("from_entity_id"), F.col("path").alias("from_path")), "from_entity_id")
    types = entities.where("lower(language) = 'java' and kind in ('CLASS', 'INTERFACE') and qualified_name is not null")
    types = types.groupBy("qualified_name").agg(F.min_by("id", "ord").alias("id"))
    file_modules = entities.where("kind = 'MODULE'").groupBy("name").agg(F.min_by("id", "ord").alias("id"))
    usable = depends.where(F.col("label").isNotNull() & (F.trim("label") != ""))
    targets = resolver(usable.select("rel_id", "label", "from_path"), types, file_modules)
    ends = entities.select(F.col("id").alias("target_id"), F.get("source_refs", F.lit(0))["path"].alias("to_path"))
    inside = usable.join(targets, "rel_id").join(ends, "target_id")
    direct = inside.select(F.col("from_entity_id").alias("from_id"), F.col("target_id").alias("to_id"), "label", F.col("rel_refs").alias("source_refs"), F.col("rel_ord").alias("ord"), "rel_id")
    lifted = inside.join(file_package.select(F.col("path").alias("from_path"), F.col("package").alias("from_package")), "from_path", "left").join(file_package.select(F.col("path").alias("to_path"), F.col("package").alias("to_package")), "to_path", "left")
    between = lambda a, b: lifted.select(a.alias("from_id"), b.alias("to_id"), "label", F.col("rel_refs").alias("source_refs"), F.col("rel_ord").alias("ord")).where("from_id is not null and to_id is not null")
    by_package = distinct_edges(between(package_entity(F.col("from_package")), package_entity(F.col("to_package"))), F.col("ord"))
    by_module = distinct_edges(between(module_entity(paths.module_root(F.col("from_path"))), module_entity(paths.module_root(F.col("to_path")))), F.col("ord"))

    ord = F.col("ord")
    edges = [
        _edges(nested, "topology-contains", "CONTAINS", "package-subpackage", 0, ord),
        _edges(in_module, "topology-contains", "CONTAINS", "module-file", 1, ord),
        _edges(tops, "topology-contains", "CONTAINS", "module-package", 2, ord),
        _edges(in_package, "topology-contains", "CONTAINS", "package-file", 3, ord),
        _edges(direct, "topology-uses", "USES", "file-internal", 4, ord, sourceRelationshipId=F.col("rel_id")),
        _edges(by_package, "topology-uses", "USES", "package-package", 5, ord),
        _edges(by_module, "topology-uses", "USES", "module-module", 6, ord),
    ]
    union = lambda frames: first_wins(reduce(DataFrame.unionByName, frames), "id", ord)
    return Topology(union([folders, module_scopes, package_scopes]), union([module_entities, package_entities]), union(edges))


def scopes_by_name(shape: Topology) -> DataFrame:
    """The inferred scopes in order of their shown names, ties in order of inference: folders, modules, packages."""
    kind = F.when(F.col("kind") == "DIRECTORY", 0).when(F.col("kind") == "MODULE", 1).otherwise(2)
    return shape.scopes.orderBy("display_name", kind, "ord")
