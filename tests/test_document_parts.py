"""Documents are written by tasks: no fact passes through the driver's Python, and each stands as its row says."""

import hashlib
import json
from types import SimpleNamespace

import pytest
from pyspark.sql.types import StructType

from stratagraph.plans import document
from stratagraph.schemas import ENTITIES
from stratagraph.sources import repository


def _fact(row: dict) -> dict:
    out = {document.camel(k): v for k, v in row.items()}
    if "sourceRefs" in out:
        out["sourceRefs"] = [{document.camel(k): v for k, v in r.items()} for r in out["sourceRefs"] or []]
    return out | ({"metadata": json.loads(out["metadata"])} if isinstance(out.get("metadata"), str) else {})


REF = ("p", 1, 2, 'a "snippet"\n\\ \x01', {"b": "ß ", "a": None})
ODD = [
    ("z", "CLASS", None, "", "\t", None, [REF, (None, None, None, None, None)], '{"b": {"d": 1.50, "c": 123456789012345678901234567890123456789012345}, "a": [1e400, true, null, "}],"]}'),
    ("a", "CLASS", "x", "\U0001f600]},", "y", "s", None, None),
    ("m", "CLASS", "x", "n", "y", "s", [], '{\n"z": 1,\r\n"y": "\\n"}'),
    ("b", "CLASS", "x", "n", "y", "s", [], "{}"),
]


def test_lines_are_the_rows(spark):
    frame = spark.createDataFrame(ODD, ENTITIES)
    got = [r.value for r in document.lines(frame.orderBy("id")).collect()]
    pairs = lambda t: json.loads(t, object_pairs_hook=lambda p: [list(x) for x in p])
    assert [json.loads(t) for t in got] == [_fact(r.asDict(recursive=True)) for r in frame.orderBy("id").collect()]
    assert [pairs(t) for t in got] == [pairs(json.dumps(json.loads(t), sort_keys=True)) for t in got] and not any("\n" in t or "\r" in t for t in got)
    plain = frame.select("kind", "id").orderBy("id")
    assert [r.value for r in document.lines(plain).collect()][0] == '{"id":"a","kind":"CLASS"}'


@pytest.mark.parametrize("tasks", [1, 3, 7])
def test_parts_are_joined(spark, tmp_path, tasks):
    rows = [(f"{i:03}",) for i in range(5)]
    made = ["[", spark.createDataFrame(rows, "value string").repartitionByRange(tasks, "value").sortWithinPartitions("value"), "]", spark.createDataFrame([], "value string"), "ß"]
    size, sha = document._put(spark, f"file://{tmp_path}/deep/x.json", iter(made), f"file://{tmp_path}/work")
    raw = (tmp_path / "deep/x.json").read_bytes()
    assert raw.decode() == "[\n" + ",\n".join(r[0] for r in rows) + "]ß"
    assert (size, sha) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert sorted(p.name for p in tmp_path.rglob("*") if "crc" not in p.name) == ["deep", "work", "x.json"]


def test_facts_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    made = document.sample("1")
    rows = lambda ddl: spark.range(40).selectExpr("format_string('%02d', 39 - id) as id", "'{}' as metadata").selectExpr(*(n if n in ("id", "metadata") else f"cast(null as {t}) as {n}" for n, t in ddl))
    tables = {n: rows([(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(ddl)]) for n, ddl in document.ARRAYS.items()}
    result = SimpleNamespace(**tables, inventory=spark.createDataFrame([(f"web/c{i}.ts", 9) for i in range(40)], "relative_path string, size long"))
    top = {k: v for k, v in made.items() if k not in document.ARRAYS}
    monkeypatch.setattr(type(result.inventory), "toLocalIterator", lambda *a, **k: pytest.fail("facts were brought to the driver"))
    document._put(spark, f"file://{tmp_path}/x.json", document.text(result, top), f"file://{tmp_path}/work")
    whole = json.loads((tmp_path / "x.json").read_text())
    for name in document.ARRAYS:
        assert whole[name] == [_fact(r.asDict(recursive=True)) for r in getattr(result, name).orderBy("id").collect()] and len(whole[name]) == 40
    assert [e["relativePath"] for e in whole["inventoryEntries"]] == sorted(f"web/c{i}.ts" for i in range(40))
    assert not list((tmp_path / "work").glob("lines-*"))
    # the head is read from its own lines, not by a pass over the whole document
    monkeypatch.setattr(type(repository.read_document(spark, f"file://{tmp_path}/x.json")), "first", lambda *a: pytest.fail("the document was read as one row"))
    head, tables = document.read(spark, f"file://{tmp_path}/x.json")
    assert head == {k: whole[k] for k in head} and set(head) == {"schemaVersion", "indexerVersion", "runMetadata", "source", "completeness", "metadata"}
    assert all(tables[n].count() == len(whole[n]) for n in document.ARRAYS)


@pytest.mark.parametrize("part", ['"schemaVersion": "1", "indexerVersion": "2"', '"schemaVersion": "1",\n"indexerVersion": "2"', '"schemaVersion": "1",\n"indexerVersion": "2",\n"x": "' + "y" * 70000 + '"'], ids=["two parts a line", "a part a line", "long line"])
def test_heads(spark, tmp_path, part):
    (tmp_path / "x.json").write_text("{\n" + part + ',\n"source": {"a": [null, 1]},\n"scopes": [\n{"id": "s", "kind": "FILE"}]\n}\n')
    head, tables = document.read(spark, f"file://{tmp_path}/x.json")
    assert head == {"schemaVersion": "1", "indexerVersion": "2", "source": {"a": [None, 1]}, "runMetadata": None, "completeness": None, "metadata": None}
    assert [r.id for r in tables["scopes"].collect()] == ["s"]
