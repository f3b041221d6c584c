"""Stored documents are read by lines: no task holds a whole one, and other layouts give the same tables."""

import json

import pytest

from stratagraph.plans import document
from stratagraph.sources import repository


def _row(i: int) -> dict:
    return {"id": f"rel:{i}", "kind": "USES", "fromEntityId": "a", "toEntityId": "b", "label": f"\u2028{i}]}},", "sourceRefs": [{"path": f"p{i}", "startLine": i, "metadata": {"k": "}],"}}], "metadata": {"n": [i]}}


FACTS = [_row(i) for i in range(300)]


def _text(arrays: str) -> str:
    return '{\n"schemaVersion": "1.0.0",\n"metadata": {"x": 1},\n"scopes": [],\n' + arrays + "\n}\n"


def _by_line(facts: list[str]) -> str:
    return _text('"relationships": [\n' + ",\n".join(facts) + '],\n"inventoryEntries": [\n{"relativePath": "x"}]')


def _got(tables: dict) -> list:
    return sorted((r.id, r.label, r.source_refs[0].path, r.source_refs[0].start_line, r.source_refs[0].metadata["k"], json.loads(r.metadata)["n"]) for r in tables["relationships"].collect())


WANT = sorted((f["id"], f["label"], f["sourceRefs"][0]["path"], i, "}],", [i]) for i, f in enumerate(FACTS))
ONE = [json.dumps(f, ensure_ascii=False) for f in FACTS]


def test_facts_are_spread_over_tasks(spark, tmp_path):
    (tmp_path / "x.json").write_text(_by_line(ONE))
    conf, key = spark._jsc.hadoopConfiguration(), "mapreduce.input.fileinputformat.split.maxsize"
    conf.set(key, "4000")
    try:
        head, tables = document.read(spark, f"file://{tmp_path}/x.json")
        sizes = tables["relationships"].rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(sizes) == len(FACTS) and max(sizes) < len(FACTS) // 4
        assert _got(tables) == WANT and head["schemaVersion"] == "1.0.0"
        assert all(tables[n].isEmpty() for n in ("scopes", "entities", "diagnostics"))
    finally:
        conf.unset(key)


@pytest.mark.parametrize(
    "text",
    [
        _by_line([", ".join(ONE[:2]), *ONE[2:]]),
        _text('"relationships": [' + ",\n".join(ONE) + "]"),
        _text('"relationships": [\n' + ",\n".join(ONE) + "\n]"),
        json.dumps({"schemaVersion": "1.0.0", "relationships": FACTS}),
        json.dumps({"schemaVersion": "1.0.0", "relationships": FACTS}, indent=0),
        json.dumps({"schemaVersion": "1.0.0", "relationships": FACTS}, indent=2),
    ],
    ids=["two facts a line", "first fact beside the name", "end on its own line", "one line", "unindented", "indented"],
)
def test_any_layout(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    head, tables = document.read(spark, f"file://{tmp_path}/x.json")
    assert _got(tables) == WANT and head["schemaVersion"] == "1.0.0"


def test_a_broken_line_is_told(spark, tmp_path):
    (tmp_path / "x.json").write_text(_by_line([*ONE[:5], '{"id": }', *ONE[5:]]))
    with pytest.raises(Exception, match="no fact at byte"):
        repository.document_tables(spark, f"file://{tmp_path}/x.json", document.ARRAYS)["relationships"].collect()
