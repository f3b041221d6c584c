"""Documents whose facts have different tokens of one CRC32: no query may lose or mix them."""

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers the queries
from stratagraph.plans import queries as plans

#: Ids of each pair meet: in TypeScript entities, in imports, in what modules hold, in files, in links of roles; the last two in imports of files that are there.
PAIRS = [(1041, 42857), (23217, 33404), (49888, 58062), (29631, 99963), (43861, 308217), (8265, 9000), (8277, 9004)]
QUERIES = "code_entities code_ids code_index code_relationships code_summary code_dependencies code_containment code_roles code_stage_summaries stored_document".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("crc"))
    spark.createDataFrame([(n,) for pair in PAIRS for n in pair], "doc_id long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_as_sql(spark, folder, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    frame = plans.QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    got = sorted(tuple(map(str, r)) for r in frame.select(*columns).collect())
    want = sorted(tuple(map(str, r)) for r in db.sql(f"select {','.join(columns)} from ({plans.SQL[name]})").fetchall())
    assert got == want and got
