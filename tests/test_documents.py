"""Documents, manifests, snapshots and jobs: written, read again, and refused."""

import hashlib
import json

import pytest

from stratagraph import cli, http_worker, worker, workspace
from stratagraph.operators import assess, export, incremental, inventory
from stratagraph.plans import document, pipeline
from stratagraph.schemas import FILES
from stratagraph.sources import repository
from stratagraph.sources.repository import Source

FILES_ = {
    "src/main/java/a/Greeter.java": "package a;\n@Service class Greeter {}\n",
    "web/app.ts": "import { x } from './größe';\nexport class App {}\n",
    "web/größe.ts": "export class Größe {}\n",
    "conf/app.properties": "api.url=https://api.example.org/v1\n",
    "node_modules/x.js": "x",
}
SOURCE = Source("demo", "/somewhere", "LOCAL_PATH", "main", "abc")


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    files = spark.createDataFrame([(p, len(c), c) for p, c in FILES_.items()], FILES)
    return pipeline.index(spark, files, f"file://{tmp_path_factory.mktemp('work')}", "demo")


def rows(frame):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, ensure_ascii=False) for r in frame.collect())


def test_document_round_trip(spark, result, tmp_path):
    path = f"file://{tmp_path}/deep/index.json"
    top, made = document.write(spark, result, path, SOURCE, "9.9")
    raw = (tmp_path / "deep/index.json").read_bytes()
    assert made["payloadSha256"] == hashlib.sha256(raw).hexdigest() and made["payloadSizeBytes"] == len(raw)
    assert json.loads((tmp_path / "deep/index.manifest.json").read_text()) == made == json.loads(document.preview(made))
    assert made["contract"]["compatibility"] == {"schemaMatches": True, "payloadTypeMatches": True, "contractVersionSupported": True, "compatible": True, "targetRecommendation": "safe-to-import"}
    whole = json.loads(raw)
    assert made["metadata"] == {"entityCount": len(whole["entities"]), "relationshipCount": len(whole["relationships"]), "scopeCount": len(whole["scopes"]), "outcome": "SUCCESS"}
    assert whole["source"]["repositoryId"] == "demo" and whole["source"]["revision"] == "abc"
    assert whole["completeness"]["omittedPaths"] == ["node_modules/x.js"] and whole["completeness"]["indexedFileCount"] == 4
    assert {e["relative_path"] if "relative_path" in e else e["relativePath"] for e in whole["inventoryEntries"]} == set(FILES_)
    root = next(e for e in whole["entities"] if e["id"] == "entity:inventory:root")
    assert root["origin"] == "INFERRED" and root["sourceRefs"][0]["path"] == "conf/app.properties" and root["metadata"]["indexedFileCount"] == 4
    note = next(d for d in whole["diagnostics"] if d["code"] == "inventory.scan.complete")
    assert note["entityId"] == root["id"] and note["metadata"] == {"totalFiles": 5, "ignoredFiles": 1}
    head, tables = document.read(spark, path)
    assert head["schemaVersion"] == "1.0.0" and head["runMetadata"]["outcome"] == "SUCCESS" and head["source"]["branch"] == "main"
    for name, table in tables.items():
        own = getattr(result, name).select(*table.columns)
        plain = lambda f: sorted((r["id"], json.dumps(json.loads(r["metadata"]), sort_keys=True), json.dumps([x.asDict() for x in r["source_refs"]], sort_keys=True)) for r in f.collect())
        assert plain(table) == plain(own)
        assert rows(table.drop("metadata")) == rows(own.drop("metadata"))
    assert assess.violations(*(tables[n] for n in ("scopes", "entities", "relationships"))).isEmpty()


def test_broken_documents_are_refused(spark, result, tmp_path):
    broken = pipeline.Index(**{**result.__dict__, "relationships": result.relationships.unionByName(result.relationships.limit(1))})
    with pytest.raises(ValueError, match="duplicate id within payload"):
        document.write(spark, broken, f"file://{tmp_path}/x.json", SOURCE, "1")
    with pytest.raises(ValueError, match="indexerVersion must be present"):
        document.write(spark, result, f"file://{tmp_path}/x.json", SOURCE, " ")
    assert not list(tmp_path.iterdir())
    assert assess.header_violations({}) == [f"{k} must be present" for k in ("schemaVersion", "indexerVersion", "runMetadata", "source", "completeness")]


def test_sample_is_a_valid_document(spark, tmp_path):
    made = document.sample("1.2")
    assert not assess.header_violations(made) and export.evaluate(export.contract("1.2"), made)["compatible"]
    assert not export.evaluate(export.contract("1.2"), made | {"schemaVersion": "2"})["compatible"]
    (tmp_path / "s.json").write_text(json.dumps(made | {"unknownPart": [1]}))
    head, tables = document.read(spark, f"file://{tmp_path}/s.json")
    assert head["indexerVersion"] == "1.2" and tables["scopes"].first().id == "scope:repo" and tables["relationships"].isEmpty()
    assert assess.violations(tables["scopes"], tables["entities"], tables["relationships"]).isEmpty()


def test_snapshots_as_json(spark, result, tmp_path):
    taken = incremental.snapshot(result.inventory)
    path = f"file://{tmp_path}/snap.json"
    repository.write_snapshot_json(spark, taken, path, 5)
    again = repository.read_snapshot(spark, path)
    assert rows(again) == rows(taken) and not incremental.plan(incremental.diff(again, taken)).first().incremental
    whole = json.loads(next((tmp_path / "snap.json").glob("part-*")).read_text())
    assert whole["schemaVersion"] == "1" and whole["metadata"] == {"indexedFileCount": 4, "totalFileCount": 5} and whole["createdAt"]
    assert repository.read_snapshot(spark, f"file://{tmp_path}/none") is None
    (tmp_path / "bad.json").write_text("[1")
    assert repository.read_snapshot(spark, f"file://{tmp_path}/bad.json") is None


def test_plans(spark):
    none = incremental.plan(None).first()
    assert (none.incremental, none.parse_paths, none.reason) == (False, [], "no-diff")
    changes = spark.createDataFrame([("b", "changed"), ("a", "changed"), ("z", "added"), ("q", "removed"), ("u", "unchanged")], "relative_path string, change string")
    assert [r.relative_path for r in incremental.reprocessed(changes).where("turn < 2").orderBy("turn", "relative_path").collect()] == ["z", "a", "b"]
    assert incremental.counts(changes).first().asDict() == {"incremental": True, "added_count": 1, "changed_count": 2, "removed_count": 1, "unchanged_count": 1, "strategy": "reprocess-added-and-changed"}


def test_omitted_paths_as_rows(spark, result):
    files = spark.createDataFrame([(p, len(c), c) for p, c in FILES_.items()], FILES)
    found = inventory.inventory(files)
    assert [r.relative_path for r in assess.omitted(found).collect()] == ["node_modules/x.js"]
    assert "omitted_paths" not in assess.assess(found, result.parses, result.diagnostics, listed=False).columns


def write_tree(folder):
    for path, text in FILES_.items():
        at = folder / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_jobs_with_documents(spark, tmp_path, capsys):
    write_tree(tmp_path / "repo")
    (tmp_path / "work").mkdir()
    ask = dict(sourcePath=str(tmp_path / "repo"), outputPath=str(tmp_path / "out.json"), snapshotOut=str(tmp_path / "snap.json"), snapshotIn=str(tmp_path / "none"))
    out = worker.run_job(spark, worker.JobRequest(jobId="j", repositoryId="r", **ask), str(tmp_path / "work"))
    assert out["status"] == "SUCCESS" and json.loads((tmp_path / "out.json").read_text())["source"]["repositoryId"] == "r"
    keys = ["status", "repositoryId", "acquisitionType", "sourcePath", "output", "schemaVersion", "indexedFiles", "ignoredFiles", "detectedLanguages", "detectedTechnologyMarkers", "parserRuntime", "parseSummary", "extractionSummary", "interpretationSummary", "topologySummary", "diagnosticSummary", "partialResult", "incrementalPlan", "incrementalPaths", "exportManifestPreview"]
    assert list(out["summary"])[:20] == keys
    assert out["summary"]["incrementalPaths"] == sorted(set(FILES_) - {"node_modules/x.js"}) and out["summary"]["extractionSummary"]["byMode"] == {"SYNTAX_TREE": 4}
    assert not list((tmp_path / "work").iterdir())  # the workspace is cleared
    code = cli.main(["--source", str(tmp_path / "repo"), "--output", str(tmp_path / "b.json"), "--snapshot-in", str(tmp_path / "snap.json"), "--workspace", str(tmp_path / "work")])
    said = capsys.readouterr().out
    assert code == 0 and json.loads(said[said.index("{") :])["incrementalPlan"]["strategy"] == "full-or-noop"


def test_http_errors(spark, tmp_path):
    run = lambda request: worker.run_job(spark, request, str(tmp_path))
    status, body = http_worker.answer("POST", http_worker.RUN, json.dumps({"jobId": "j", "sourcePath": "/no/such/folder", "outputPath": "x", "gitRef": None}), run)
    assert status == 400 and body["code"] == "invalid_request" and body["jobId"] == "j"
    assert body["details"]["sourcePath"] == "/no/such/folder" and "gitRef" not in body["details"] and body["details"]["exceptionType"] == "ValueError"
    status, body = http_worker.answer("POST", http_worker.RUN, json.dumps({"gitUrl": f"file://{tmp_path}/none", "outputPath": "x"}), run)
    assert status == 500 and body["code"] == "job_failed" and body["details"]["exceptionType"] == "RuntimeError"
    status, body = http_worker.answer("GET", http_worker.RUN, "", run)
    assert status == 405 and body["code"] == "method_not_allowed" and body["details"] == {"allowedMethod": "POST"}
    assert http_worker.answer("POST", http_worker.RUN, "{", run)[1]["code"] == "job_failed"


class Context:
    def __init__(self, local):
        self.conf, self.sparkContext, self._jsc, self._local = {}, self, self, local

    def getConf(self):
        return self.conf

    def sc(self):
        return self

    def isLocal(self):
        return self._local


def test_a_cluster_needs_a_shared_workspace():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared(Context(False))
    assert workspace.shared(Context(False), "hdfs:///x/") == "hdfs:///x" and workspace.shared(Context(True)).startswith("file:///")
    with pytest.raises(ValueError, match="mount"):
        workspace.local("hdfs:///x")
