import json

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import assess, dedup, extract, incremental, interpret, inventory, topology, tree
from stratagraph.parse import run as parsing
from stratagraph.parse.backends import PlainBackend, UnavailableBackend, flatten
from stratagraph.plans import pipeline
from stratagraph.schemas import FILES, NODES, PARSES, SNAPSHOT

CONTROLLER = '''package net.harbour.dock;
import net.harbour.crew.CrewRepository;
@RestController public class DockController {
  @GetMapping("/berths") public String getBerths() { return "ok"; }
}
'''
REPO = {
    "src/main/java/net/harbour/dock/DockController.java": CONTROLLER,
    "src/main/java/net/harbour/crew/CrewRepository.java": "package net.harbour.crew;\npublic class CrewRepository {}\n",
    "src/main/ts/app/main.ts": "import { x } from './signal-client';\n@Component export class QuayComponent {}\nfunction bootstrapQuay() {}\n",
    "src/main/ts/app/signal-client.ts": "export const call = () => 1;\n",
    "db/schema.sql": "create table orders (id int);\nselect * from customers;\n",
    "config/app.json": '{"baseUrl": "https://api.example.org/v1"}',
    "config/application.properties": "spring.datasource.url=jdbc:postgresql://localhost:5432/app\n",
    "web/app.js": "x",
    "node_modules/lib/index.js": "x",
    "docs/blob.bin": "1234",
    "pom.xml": "<a>spring-boot</a>",
}


def repo(spark, files=REPO):
    return spark.createDataFrame([(p, len(c), c) for p, c in files.items()], FILES)


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    return pipeline.index(spark, repo(spark), f"file://{tmp_path_factory.mktemp('work')}", "demo")


def by_name(result, kind):
    return {r.name: r for r in result.entities.where(F.col("kind") == kind).collect()}


def test_inventory(spark):
    rows = {r.relative_path: r for r in inventory.inventory(repo(spark)).collect()}
    assert rows["pom.xml"].candidate_technology_markers == ["build", "spring", "xml"]
    assert rows["node_modules/lib/index.js"].ignored and not rows["web/app.js"].ignored
    assert rows["docs/blob.bin"].type == "bin" and rows["docs/blob.bin"].detected_language is None
    assert rows["config/application.properties"].type == "config"
    total = inventory.summary(inventory.inventory(repo(spark))).first()
    assert (total.total_files, total.ignored_files, total.indexed_files) == (11, 1, 10)


def test_endpoint_and_roles(result):
    assert "GET /berths" in by_name(result, "ENDPOINT")
    exposes = result.relationships.where("kind = 'EXPOSES'").collect()
    owner = by_name(result, "CLASS")["DockController"]
    assert [r.from_entity_id for r in exposes] == [owner.id]
    assert json.loads(owner.metadata)["annotations"] == ["RestController", "GetMapping"]
    assert by_name(result, "FUNCTION")["GetMapping"].display_name == "GetMapping()"
    assert "CrewRepository" in by_name(result, "PERSISTENCE_ADAPTER")
    assert "QuayComponent" in by_name(result, "UI_MODULE")
    assert {"bootstrapQuay", "QuayComponent", "src/main/ts/app/main.ts"} <= set(by_name(result, "STARTUP_POINT"))


def test_config_and_sql(result):
    stores = by_name(result, "DATASTORE")
    assert stores["orders"].origin == "OBSERVED" and stores["customers"].origin == "INFERRED"
    assert stores["customers"].scope_id == "scope:repo"
    assert "spring.datasource.url" in stores and "localhost:5432" in stores
    assert by_name(result, "CONFIG_ARTIFACT")["baseUrl"].display_name == "baseUrl"


def test_topology(result):
    scopes = {(r.kind, r.name): r for r in result.scopes.collect()}
    assert scopes["PACKAGE", "net.harbour"].parent_scope_id == scopes["PACKAGE", "net"].id
    assert scopes["DIRECTORY", "src/main"].parent_scope_id == scopes["DIRECTORY", "src"].id
    rollups = {}
    names = {r.id: r.name for r in result.entities.collect()}
    for r in result.relationships.where("metadata like '%rollup%'").collect():
        rollups.setdefault(json.loads(r.metadata)["rollup"], set()).add((names[r.from_entity_id], names[r.to_entity_id]))
    assert ("net.harbour.dock", "net.harbour.crew") in rollups["package-package"]
    assert ("src/main/ts/app/main.ts", "src/main/ts/app/signal-client.ts") in rollups["file-internal"]
    assert ("net", "net.harbour") in rollups["package-subpackage"]
    assert ("src/main/java", "net") in rollups["module-package"]
    assert "module-module" not in rollups


def test_assessment_and_validation(spark, result, tmp_path):
    a = result.assessment.first()
    assert a.outcome == "PARTIAL" and a.unsupported == 1  # the .js file
    assert a.omitted_paths == ["node_modules/lib/index.js"]
    assert assess.violations(result.scopes, result.entities, result.relationships).isEmpty()
    manifest = pipeline.export_index(spark, result, f"file://{tmp_path}/out")
    assert manifest["exportId"] == manifest["payloadSha256"][:12]
    assert json.loads(pipeline.document(result, "demo"))["schemaVersion"] == "1.0.0"


def test_violations(spark):
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "")], "id string, name string")
    r = spark.createDataFrame([("r", "a", "zz")], "id string, from_entity_id string, to_entity_id string")
    said = sorted(x.message for x in assess.violations(e.limit(0), e, r).collect())
    assert said == ["duplicate id within payload: a", "entity name must be present for b", "relationship references missing toEntityId: r"]


def test_incremental(spark):
    row = lambda p, n: (p, n, f"{p}{n}", None, "source")
    before = spark.createDataFrame([row("A", 100), row("B", 100), row("C", 100)], SNAPSHOT)
    after = spark.createDataFrame([row("A", 100), row("B", 120), row("C", 100), row("D", 50)], SNAPSHOT)
    plan = incremental.plan(incremental.diff(before, after)).first()
    assert plan.parse_paths == ["D", "B"] and plan.incremental and plan.removed_paths == []
    assert not incremental.plan(incremental.diff(before, before)).first().incremental
    assert {r.change for r in incremental.diff(None, before).collect()} == {"added"}
    assert incremental.plan(incremental.diff(before, before.where("relative_path <> 'B'"))).first().removed_paths == ["B"]


def test_precedence_union(spark):
    one = lambda rows: spark.createDataFrame(rows, "id string, v string, ord int")
    out = {r.id: (r.v, tuple(r.position)) for r in dedup.precedence_union([one([("a", "1", 0), ("b", "1", 1)]), one([("b", "2", 0), ("c", "2", 1)])], "id").collect()}
    assert out == {"a": ("1", (0, 0)), "b": ("2", (0, 1)), "c": ("2", (1, 1))}


def test_nearest_preceding_ties(spark):
    points = spark.createDataFrame([("f", 12, "m"), ("f", 1, "n"), ("g", 9, "o")], "path string, line int, id string")
    events = spark.createDataFrame([("f", 5, "first", 0), ("f", 5, "second", 1), ("f", 2, "early", 2)], "path string, line int, id string, ord int")
    out = {r.id: r.near_id for r in interpret.nearest_preceding(points, events, "path", "line", ["id"], "ord").collect()}
    assert out == {"m": "first", "n": None, "o": None}


def test_tree_nesting(spark):
    tree_ = PlainBackend().parse("java", CONTROLLER)
    rows = list(flatten("x", tree_))
    nodes = spark.createDataFrame([tuple(r[c] for c in [x.strip().split()[0] for x in NODES.split(",")]) for r in rows], NODES)
    assert rows[0]["last"] == len(rows) - 1
    again = {(r.pre, r["last"]) for r in tree.nested(nodes.drop("last")).collect()}
    assert again == {(r["pre"], r["last"]) for r in rows}
    types = nodes.where("type = 'class_declaration'")
    assert [r.d_text for r in tree.descendants(types, nodes, ["identifier"]).orderBy("d_pre").collect()] == ["DockController", "getBerths"]
    assert tree.first_descendant(types, nodes, ["identifier"], "n").first().n == "DockController"
    assert tree.has_descendant(types, nodes, "method_declaration").count() == 1 and tree.has_descendant(types, nodes, "nothing").isEmpty()


def test_parse_failures(spark):
    files = spark.createDataFrame([("a.java", 3, None), ("b.java", 1, "class A {}"), ("c.js", 1, "x")], FILES)
    found = inventory.inventory(files)
    rows = {r.path: r for r in parsing.split(parsing.parse(files, found))[0].collect()}
    assert rows["a.java"].status == "PARSE_ERROR" and rows["a.java"].issues[0].fatal
    assert rows["b.java"].status == "SUCCESS" and rows["c.js"].status == "UNSUPPORTED_LANGUAGE"
    parses, nodes = parsing.split(parsing.parse(files, found, UnavailableBackend()))
    assert {r.status for r in parses.where("path = 'b.java'").collect()} == {"BACKEND_UNAVAILABLE"}
    facts = extract.extract(nodes, parses)
    assert {r.code for r in facts.diagnostics.collect()} == {"extract.java.syntax-tree-required"}
    assert assess.assess(found, parses, assess.parse_diagnostics(parses)).first().outcome == "FAILED"


def test_resolver_order(spark):
    edges = spark.createDataFrame([("1", "./m", "a/b.ts"), ("2", "com.x.T", "a/B.java"), ("3", "./none", "a/b.ts")], "rel_id string, label string, from_path string")
    types = spark.createDataFrame([("com.x.T", "t")], "qualified_name string, id string")
    modules = spark.createDataFrame([("a/m/index.ts", "i"), ("a/m.tsx", "x")], "name string, id string")
    assert {(r.rel_id, r.target_id) for r in topology.default_resolver(edges, types, modules).collect()} == {("1", "x"), ("2", "t")}
