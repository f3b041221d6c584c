"""Extension seams, fact order, package rules and the parser runtime."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import assess, extract, interpret, topology, tree
from stratagraph.parse import run as parsing
from stratagraph.parse import runtime
from stratagraph.parse.backends import Node, PlainBackend, Registry, Tree, UnavailableBackend
from stratagraph.plans import pipeline
from stratagraph.schemas import FILES


def files(spark, found):
    return spark.createDataFrame([(p, len(c), c) for p, c in found.items()], FILES)


def test_first_of_over_ten_imports_labels_the_edge(spark, tmp_path):
    outside = "".join(f"import {{ x }} from 'lib-{i}';\n" for i in range(8))
    found = {
        "a/m.ts": outside + "import { x } from '../b/first';\nimport { y } from '../b/second';\nexport class M {}\n",
        "b/first.ts": "export class First {}\n",
        "b/second.ts": "export class Second {}\n",
    }
    out = pipeline.index(spark, files(spark, found), f"file://{tmp_path}", "demo")
    edges = out.relationships.where(F.get_json_object("metadata", "$.rollup") == "module-module").collect()
    assert [r.label for r in edges] == ["../b/first"]


def test_packages_take_refs_of_the_nearest_stated(spark):
    rows = [("a.b.c", "java", ["one"], 1), ("a.z", "java", ["two"], 2), ("x.y", "java", ["three"], 3), ("x.y", "java", ["four", "five"], 4), ("x.y", "java", ["six", "seven"], 5), ("a", "kotlin", ["k"], 6)]
    got = {(r.name, r.language): (r.refs, r.parent) for r in topology.package_closure(spark.createDataFrame(rows, "name string, language string, refs array<string>, ord int")).collect()}
    assert got == {
        ("a.b.c", "java"): (["one"], "a.b"), ("a.b", "java"): (["one"], "a"), ("a", "java"): (["two"], None), ("a.z", "java"): (["two"], "a"),
        ("x.y", "java"): (["four", "five"], "x"), ("x", "java"): (["four", "five"], None), ("a", "kotlin"): (["k"], None),
    }


def test_scopes_by_name(spark, tmp_path):
    out = files(spark, {"b/A.java": "package p.b;\nclass A {}\n", "a/C.java": "package p.a;\nclass C {}\n"})
    parses, nodes = parsing.split(parsing.parse(out))
    facts = extract.extract(nodes, parses)
    from stratagraph.operators import inventory

    shape = topology.infer(inventory.inventory(out), facts.scopes, facts.entities, facts.relationships)
    assert [(r.display_name, r.kind) for r in topology.scopes_by_name(shape).collect()] == [("a", "DIRECTORY"), ("a", "MODULE"), ("a", "PACKAGE"), ("b", "DIRECTORY"), ("b", "MODULE"), ("b", "PACKAGE"), ("p", "PACKAGE")]


def kotlin_backend():
    class Kotlin:  # local, so that it travels to the workers by value
        name = "kotlin-words"

        def parse(self, language, text):
            return Tree(Node("program", 0, len(text), [Node("thing", 0, len(text))]), text)

    return Kotlin()


def kotlin(nodes, reads):
    rows = nodes.where("type = 'thing'").join(reads.select("path"), "path")
    ref = extract.source_ref(F.col("path"), language="kotlin")
    made = extract.entity(rows, F.concat(F.lit("entity:kotlin:"), "path"), "CLASS", "OBSERVED", F.col("text"), F.col("text"), None, ref, F.struct(F.lit("kotlin").alias("language")), "kotlin", extract.order(F.col("path"), 2, F.col("pre")))
    return extract.Found([], [made], [])


def test_more_languages(spark):
    inventory = spark.createDataFrame([("A.kt", False, "kotlin"), ("B.java", False, "java"), ("c.rb", False, "ruby")], "relative_path string, ignored boolean, detected_language string")
    backend = Registry({"java": PlainBackend()}).with_backends({"kotlin": kotlin_backend()})
    assert backend.languages == ["java", "kotlin"] and backend.find("ruby") is None
    parses, nodes = parsing.split(parsing.parse(files(spark, {"A.kt": "thing", "B.java": "class B {}", "c.rb": "x"}), inventory, backend))
    assert {r.path: (r.status, r.parser_backend) for r in parses.collect()} == {"A.kt": ("SUCCESS", "kotlin-words"), "B.java": ("SUCCESS", "plain-scanner"), "c.rb": ("UNSUPPORTED_LANGUAGE", None)}
    plain = extract.extract(nodes, parses)
    assert plain.entities.where("language = 'kotlin'").isEmpty()  # without an extractor a file gives nothing
    facts = extract.extract(nodes, parses, extract.with_extractors({"kotlin": kotlin}))
    assert {(r.kind, r.name) for r in facts.entities.where("language = 'kotlin'").collect()} == {("MODULE", "A.kt"), ("CLASS", "thing")}
    assert {r.name for r in facts.entities.where("kind = 'CLASS'").collect()} == {"thing", "B"}
    last = extract.with_extractors({"java": kotlin})
    assert last["java"] is kotlin and len(last) == len(extract.EXTRACTORS)
    one = extract.summary(parses, facts, extract.with_extractors({"kotlin": kotlin})).first()
    assert (one.files_visited, one.files_extracted, one.by_language, one.by_mode) == (2, 2, {"java": 1, "kotlin": 1}, {"SYNTAX_TREE": 2})
    assert {r.name for r in extract.in_file(facts.entities, "B.java").collect()} == {"B.java", "B"}
    assert extract.extract(nodes, parses, {"kotlin": kotlin}).relationships.isEmpty()


def test_more_rules(spark):
    parses, nodes = parsing.split(parsing.parse(files(spark, {"A.java": "class AService {}"})))
    entities = extract.extract(nodes, parses).entities
    found = []

    def rule(rows):
        found.append(rows)
        return interpret.java_rule(rows)

    roles, links = interpret.interpret(entities, [*interpret.RULES, rule])
    assert [r.kind for r in roles.collect()] == ["SERVICE"] and links.count() == 1 and len(found) == 1


def test_subtrees_over_many_chunks(spark):
    """A file of thousands of nodes: against plain loops."""
    ends, open_, rows = {}, [], []
    for pre in range(1500):
        depth = 0 if pre == 0 else 1 + (pre * 7919 % 5 if pre % 3 else 0)
        depth = min(depth, (rows[-1][2] + 1) if rows else 0)
        while open_ and rows[open_[-1]][2] >= depth:
            ends[open_.pop()] = pre - 1
        open_.append(pre)
        rows.append(("f", pre, depth, f"k{pre % 7}", f"t{pre}"))
    ends |= {i: 1499 for i in open_}
    frame = tree.nested(spark.createDataFrame(rows, "path string, pre int, depth int, type string, text string"))
    assert {r.pre: r["last"] for r in frame.collect()} == ends
    above = frame.where("type = 'k3'")
    pairs = {(r.pre, r.d_pre) for r in tree.descendants(above, frame, ["k5"]).collect()}
    want = {(a, d) for a in range(3, 1500, 7) for d in range(5, 1500, 7) if a <= d <= ends[a]}
    assert pairs == want
    first = {r.pre: r.n for r in tree.first_descendant(above, frame, ["k5"], "n").collect()}
    assert first == {a: next((f"t{d}" for d in range(a, ends[a] + 1) if d % 7 == 5), None) for a in range(3, 1500, 7)}
    assert {r.pre for r in tree.has_descendant(above, frame, "k5").collect()} == {a for a, _ in want}


def test_runtime(tmp_path, monkeypatch):
    off = runtime.Configuration.from_environment({runtime.ENABLED: "False", runtime.LIBRARIES: " "})
    assert not off.enabled and off.folder is None and off.facts()["configuredFolder"] == ""
    assert not runtime.detect(off).available and "switched off" in runtime.detect(off).detail
    name = runtime.library_file("tree-sitter-java")
    assert (runtime.library_file("x", "Windows"), runtime.library_file("x", "Darwin"), runtime.library_file("x", "Linux")) == ("x.dll", "libx.dylib", "libx.so")
    assert (runtime.platform_folder("Darwin", "arm64"), runtime.platform_folder("Linux", "AMD64"), runtime.platform_folder("Sun OS", "sparc v9")) == ("macos-aarch64", "linux-x86_64", "sun-os-sparc-v9")
    given = runtime.Configuration(folder=tmp_path / "given")
    with pytest.raises(FileNotFoundError):
        runtime.locate("tree-sitter-java", given, tmp_path)
    assert runtime.locate("tree-sitter-java", runtime.Configuration(), tmp_path) == name
    for folder in (tmp_path / "lib", tmp_path / "lib" / runtime.platform_folder(), tmp_path / "given"):  # each before the one found so far
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("")
        assert runtime.locate("tree-sitter-java", given, tmp_path) == str((folder / name).resolve())
    for i in range(30):
        (tmp_path / "given" / f"f{i:02}").write_text("")
    assert runtime.listing(tmp_path / "given") == sorted(p.name for p in (tmp_path / "given").iterdir())[: runtime.LISTED]
    assert runtime.listing(Path("/no/such")) == []
    monkeypatch.setattr(runtime.importlib.util, "find_spec", lambda _: None)
    registry = runtime.grammar_registry(runtime.Configuration())
    assert registry.languages == [x.key for x in runtime.ACTIVE] and all(isinstance(registry.find(x), UnavailableBackend) for x in registry.languages)
    assert "javascript" not in registry.languages and [x.key for x in runtime.KNOWN] == ["javascript"]
    assert isinstance(runtime.default_backend(runtime.Configuration()), PlainBackend)
    monkeypatch.setattr(runtime.importlib.util, "find_spec", lambda _: object())
    there = runtime.grammar_registry(given)  # one library is there, the others are not
    assert isinstance(there.find("java"), runtime.GrammarBackend) and isinstance(there.find("sql"), UnavailableBackend)


def test_unavailable_parsers_say_why(spark):
    backend = Registry({"java": UnavailableBackend("no library")})
    row = parsing.parse(files(spark, {"a.java": "class A {}"}), None, backend).first()
    assert (row.status, row.issues[0].message, row.issues[0].fatal) == ("BACKEND_UNAVAILABLE", "no library", False)
    assert json.loads(json.dumps(runtime.Configuration().facts()))["enabled"] is True


def test_own_diagnostics(spark):
    rows = spark.createDataFrame([("a.java", "odd name"), (None, "no file")], "path string, said string")
    made = assess.warnings(rows, "rule", "INTERPRETATION", "rule.odd", F.col("said"), F.col("path"), hint=F.lit("x"))
    parsed = assess.parse_diagnostics(parsing.split(parsing.parse(files(spark, {"c.js": "x"})))[0])
    every = parsed.unionByName(made)
    assert {(r.severity, r.phase, r.file_path, len(r.source_refs)) for r in made.collect()} == {("WARNING", "INTERPRETATION", "a.java", 1), ("WARNING", "INTERPRETATION", None, 0)}
    assert {r.file_path for r in assess.degraded(every).collect()} == {"a.java", "c.js"}
