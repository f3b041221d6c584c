"""Each stage of the pipeline on nulls, empty and very long texts, ties, repeated rows, empty tables and odd columns."""

import random
from collections import Counter

import corpus_pipeline as pipeline
import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, report string, row string, score string, place string, `a.b` string, n_hit int, kept boolean, rest string, `c``d` int, spans string"
LONG = " ".join(f"w{i % 997}v{i}" for i in range(60_000))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") + str(r.randrange(400)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "o", "c", "p", f"d{i}", 5, True, "x", 3, "y") for i, t in rows], DDL)


EDGE = [(1, None), (2, ""), (3, " \n\t\n"), (4, "one"), (5, LONG), (6, prose(6, 40)), (7, prose(7, 40))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1000 + i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, prose(500, 30)), (1, "short item"), (2, None), (3, ""), (None, prose(6, 40))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def texts(out):
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_toxic(spark, folder):
    labelled = [(1000 + i, prose(i, 30) + (" grin folk vile" if i % 5 == 0 else "")) for i in range(400)]
    bad = prose(901, 25) + " vile grin folk"
    rows = EDGE + labelled + [(2000, bad), (2000, bad), (None, bad), (None, "fine words"), (None, "fine words"), (2001, LONG + " vile grin folk")]
    out = pipeline.drop_toxic(spark, docs(spark, rows), folder)
    got = texts(out)
    assert out.columns == docs(spark, []).columns and got[None, "fine words"] == 2
    assert all(got[x] == 1 for x in EDGE) and not any(got[x] for x in rows[-6:-3])
    assert {i for i, _ in got if i and 1000 <= i < 1400} == {1000 + i for i in range(400) if i % 5}
    assert pipeline.drop_toxic(spark, docs(spark, []), folder).count() == 0


def test_lines(spark, folder):
    shared, long = prose(20, 12), "\n".join(LONG[i : i + 400] for i in range(0, 40_000, 400))
    rows = [*EDGE, (30, shared + "\n" + prose(21, 9)), (31, prose(22, 9) + "\n" + shared), (32, shared), (40, long), (41, long + "\nlast line"), (50, prose(23, 20)), (50, prose(23, 20)), (None, prose(24, 20)), (None, prose(24, 20)), (51, prose(24, 20))]
    out = pipeline.drop_repeated_lines(spark, docs(spark, rows), folder)
    want = [x for x in rows if x[0] not in (31, 32, 41, 51)] + [(31, prose(22, 9)), (41, "last line")]
    assert texts(out) == Counter(want) and out.columns == docs(spark, []).columns
    changed = {r.doc_id: (r.n_chars, r["a.b"], r.report) for r in out.where("doc_id in (1, 31, 41)").collect()}
    assert changed == {1: (0, "d1", "r"), 31: (len(prose(22, 9)), "d31", "r"), 41: (9, "d41", "r")}
    assert pipeline.drop_repeated_lines(spark, docs(spark, []), folder).count() == 0
    few = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    assert pipeline.drop_repeated_lines(spark, few, folder).collect() == [(1, "a")]


def near(text, spots):
    words = text.split()
    for s in spots:
        words[s] = f"new{s}"
    return " ".join(words)


def test_near_copies(spark, folder):
    base = prose(40, 120)
    rows = [*EDGE, (60, base), (61, near(base, [30, 60])), (62, base), (63, near(base, [10, 45, 75, 110])), (70, LONG + " end"), (71, prose(41, 90))]
    out = pipeline.drop_near_copies(spark, docs(spark, rows), folder)
    assert texts(out) == Counter(x for x in rows if x[0] not in (61, 62, 70)) and out.columns == docs(spark, []).columns
    # exactly four fifths: 8 of 10 shingles
    tie = [(1, "a b c d e f g h i j k l m"), (2, "a b c d e f g h i j k l z")]
    assert pipeline.drop_near_copies(spark, docs(spark, tie), folder).count() == 1
    assert pipeline.drop_near_copies(spark, docs(spark, []), folder).count() == 0


def test_near_copies_without_ids_of_their_own(spark, folder):
    base, other = prose(40, 120), prose(43, 80)
    equal = [(1, base), (1, base), (None, base), (None, base), (9, near(base, [30]))]
    rows = [*equal, (1, other), (None, prose(44, 80)), (None, prose(44, 80)), (2, None), (2, None), (None, ""), (4, "one")]
    out = pipeline.drop_near_copies(spark, docs(spark, rows), folder)
    want = [(1, base), (1, other), (None, prose(44, 80)), (2, None), (2, None), (None, ""), (4, "one")]
    assert texts(out) == Counter(want) and out.columns == docs(spark, []).columns
    assert texts(pipeline.drop_near_copies(spark, docs(spark, [(None, base)] * 5), folder)) == Counter([(None, base)])


def test_contaminated(spark, folder):
    hit = "lead " + " ".join(prose(500, 30).split()[3:14]).upper() + " tail"
    rows = [*EDGE, (80, hit), (80, hit), (None, hit), (None, "clean words"), (81, LONG + " " + hit), (82, "a SHORT item, here"), (83, " ".join(prose(500, 30).split()[3:12]))]
    out = pipeline.drop_contaminated(spark, docs(spark, rows), folder)
    assert texts(out) == Counter([*EDGE, (None, "clean words"), (83, " ".join(prose(500, 30).split()[3:12]))]) and out.columns == docs(spark, []).columns
    assert pipeline.drop_contaminated(spark, docs(spark, []), folder).count() == 0


def test_packing(spark, folder):
    rows = [*EDGE, (90, "same"), (90, "same"), (None, "same")]
    got = pipeline.pack_tokens(spark, docs(spark, rows), folder).collect()
    assert sum(r.length for r in got if r.start == 0 and r.doc_id in (1, 2)) == 2
    parts = {}
    for r in got:
        parts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert sum(n for _, n in parts[5, next(t for i, t in parts if i == 5)]) == next(t for i, t in parts if i == 5)
    assert sum(1 for r in got if r.doc_id == 90) == 2 and sum(1 for r in got if r.doc_id is None) == 1
    assert pipeline.pack_tokens(spark, docs(spark, []), folder).count() == 0


def test_whole_run_without_rows(spark, folder, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
