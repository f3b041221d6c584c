import duckdb
import pytest

import __spark_entry__ as entry
from stratagraph.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = plans.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(map(str, r)) for r in frame.select(*columns).collect())
    want = sorted(tuple(map(str, r)) for r in db.sql(f"select {','.join(columns)} from ({plans.SQL[name]})").fetchall())
    assert got == want and got


def test_worker_and_stream(spark, tmp_path):
    from stratagraph import worker
    from stratagraph.schemas import FILES
    from stratagraph.streaming import snapshots

    source = tmp_path / "repo"
    (source / "src").mkdir(parents=True)
    (source / "src/a b.java").write_text("class A {}")
    (source / "bad.java").write_bytes(b"\xff\xfe")
    out = worker.run_job(spark, worker.JobRequest(jobId="j/1", sourcePath=str(source), outputPath=f"file://{tmp_path}/out"), str(tmp_path))
    assert out["status"] == "SUCCESS" and out["summary"]["outcome"] == "FAILED" and out["jobId"] == "j_1"
    with pytest.raises(ValueError):
        worker.JobRequest.read('{"nope": 1}')
    with pytest.raises(ValueError):
        worker.run_job(spark, worker.JobRequest(sourcePath="x"), str(tmp_path))
    assert worker.run_job(spark, worker.JobRequest(sourcePath="/none", outputPath="x"), str(tmp_path))["status"] == "FAILED"

    seen = []
    spark.createDataFrame([("a.java", 1, "x")], FILES).write.parquet(str(tmp_path / "in"))
    follow = lambda: snapshots.watch(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck"), lambda c, i: seen.extend((i, r.relative_path, r.change) for r in c.collect())).awaitTermination()
    follow()
    spark.createDataFrame([("a.java", 2, "xy"), ("b.java", 1, "y")], FILES).write.mode("append").parquet(str(tmp_path / "in"))
    follow()
    assert sorted(seen) == [(0, "a.java", "added"), (1, "a.java", "changed"), (1, "b.java", "added")]
