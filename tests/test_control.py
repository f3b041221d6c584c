import json
import threading
import urllib.error
import urllib.request

from stratagraph import http_worker, worker
from stratagraph.operators import export, summaries
from stratagraph.sources import repository


def test_http_status_codes():
    def run(request):
        if not request.outputPath:
            raise ValueError("outputPath must be given")
        if request.gitUrl:
            raise RuntimeError("no network")
        return {"status": "SUCCESS", "jobId": request.jobId, "summary": None}

    ask = lambda method, path, body="": http_worker.answer(method, path, body, run)
    assert ask("GET", "/health")[0] == 200 and ask("POST", "/health")[0] == 405
    assert ask("GET", http_worker.RUN)[0] == 405 and ask("GET", "/x")[0] == 404
    assert ask("POST", http_worker.RUN, "{")[0] == 500 and ask("POST", http_worker.RUN, '{"nope": 1}')[0] == 500
    assert ask("POST", http_worker.RUN, '{"sourcePath": "a"}')[0] == 400
    assert ask("POST", http_worker.RUN, '{"outputPath": "a", "gitUrl": "b"}')[0] == 500
    assert ask("POST", http_worker.RUN, '{"outputPath": "a", "jobId": "j"}') == (200, {"status": "SUCCESS", "jobId": "j"})
    server = http_worker.serve(0, run)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health") as reply:
        assert json.load(reply)["status"] == "UP"
    server.shutdown()
    server.server_close()


def test_contract_and_names():
    own = export.contract("1")
    assert all(export.compatibility(own, "1.0.0").values())
    assert not export.compatibility(own, "2.0.0")["schemaVersionCompatible"]
    assert repository.repository_name("https://host/team/app.git") == "app" == repository.repository_name("git@host:team/app.git")
    assert repository.identity(" ", None) == "repository" and repository.identity(" x ", "y") == "x"
    assert worker.safe_job_id("a/b c") == "a_b_c"
    assert json.loads(worker.request_json(worker.JobRequest(jobId="a"))) == {"jobId": "a"}


def test_git_sources(tmp_path):
    import subprocess

    import pytest

    origin = tmp_path / "origin"
    origin.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    assert repository.local(str(origin)).revision is None  # no commit yet
    (origin / "A.java").write_text("class A {}")
    run("add", ".")
    run("commit", "-m", "x")
    (tmp_path / "work").mkdir()
    got = repository.acquire(str(tmp_path / "work"), git_url=f"file://{origin}", ref="main")
    assert (got.repository_id, got.acquisition, got.branch, got.has_remote) == ("origin", "GIT", "main", True)
    assert got.revision == repository.local(str(origin)).revision
    with pytest.raises(ValueError):
        repository.acquire(str(tmp_path), "a", "b")
    with pytest.raises(ValueError):
        repository.local(str(tmp_path / "none"))


def test_summaries(spark):
    parses = spark.createDataFrame([("a", "java", "SUCCESS", True), ("b", "java", "PARSE_ERROR", True), ("c", "sql", "SUCCESS", True)], "path string, language string, status string, has_tree boolean")
    one = summaries.parse_summary(parses).first()
    assert (one.parseable, one.successful, one.by_language, one.by_status) == (3, 2, {"java": 2, "sql": 1}, {"SUCCESS": 2, "PARSE_ERROR": 1})
    facts = spark.createDataFrame([("1", "SERVICE", '{"ruleId": "r"}'), ("2", "ENDPOINT", '{"ruleId": "s"}')], "id string, kind string, metadata string")
    one = summaries.interpretation_summary(facts, facts.limit(1)).first()
    assert one.entities_by_kind == {"ENDPOINT": 1, "SERVICE": 1} and one.matches_by_rule == {"r": 2, "s": 1}
    one = summaries.topology_summary(facts, facts, facts.limit(0)).first()
    assert (one.scopes, one.relationships, one.relationships_by_kind) == (2, 0, {})
