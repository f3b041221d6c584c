"""The registered queries on the driver's tables, against plain second implementations."""

import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stratagraph.llm import queries, sharding, tokens, toxicity

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def byte_ids(docs):
    t = Tokenizer.from_file(BYTE)
    return {i: t.encode(x, add_special_tokens=False).ids for i, x in docs.items()}


def test_op4(spark, byte_ids):
    got = defaultdict(dict)
    for x in queries.op4_matrices(spark, SF).collect():
        ids, positions = np.frombuffer(x.ids, "<u2"), np.frombuffer(x.position_ids, "<u2")
        assert len(ids) == len(positions) == 2048 and x.cu_seqlens[0] == 0 and x.cu_seqlens[-1] == x.n_tokens <= 2048
        for d, s, a, b in zip(x.doc_ids, x.starts, x.cu_seqlens, x.cu_seqlens[1:]):
            got[d][s] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
        assert (ids[x.n_tokens :] == 50256).all()
    assert {i: sum((p[s] for s in sorted(p)), []) for i, p in got.items()} == {i: x + [50256] for i, x in byte_ids.items()}


def test_op5(spark, docs):
    t = Tokenizer.from_file(WORD)
    want = {i: (len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for i, x in docs.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op5_token_counts(spark, SF).collect()} == want


def test_op8_and_a_second_version(spark, docs, tmp_path):
    got = queries.op8_sharding(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(x.encode()) + 1, zlib.crc32(x.encode())) for i, x in docs.items()}
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} == set(range(16))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    # as near equal as giving the heaviest slot to the lightest shard makes them: by a plain second implementation
    slots = Counter()
    for r in got:
        slots[r.virtual_slot] += r.size
    load = [0] * 16
    for slot in sorted(range(sharding.SLOTS), key=lambda s: (-slots[s], s)):
        load[load.index(min(load))] += slots[slot]
    assert sorted(sum(r.size for r in own) for own in by.values()) == sorted(load)
    folder = f"file://{tmp_path}/maps"
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r.doc_id: r.shard for r in sharding.shard(frame, 16, folder).collect()}
    assert first == {r.doc_id: r.shard for r in got}
    grown = frame.unionByName(frame.limit(20).withColumn("doc_id", frame.doc_id + 10**6))
    second = sharding.shard(grown, 16, folder, version=2, previous=1).collect()
    owner = {s: {r.virtual_slot: r.shard for r in sharding.read_map(spark, folder, s).collect()} for s in (1, 2)}
    moved = {s for s in owner[1] if owner[1][s] != owner[2][s]}
    assert all(r.shard == owner[2][r.virtual_slot] for r in second) and len(moved) < 0.05 * sharding.SLOTS
    assert {r.doc_id: r.shard for r in second if r.doc_id in first and r.virtual_slot not in moved} == {r.doc_id: first[r.doc_id] for r in second if r.doc_id in first and r.virtual_slot not in moved}


def plain_score(machine, slots):
    """The machine's sum over single terms and over all pairs, one by one."""
    place = [int(machine.column[s]) for s in slots if machine.column[s] >= 0]
    z = machine.w0 + sum(machine.w[p] for p in place)
    for i, a in enumerate(place):
        for b in place[i + 1 :]:
            z += float(np.dot(machine.v[a], machine.v[b]))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def test_op9(spark):
    sf = "/root/testdata/sf0.1"
    frame, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    docs = {r.doc_id: r.text or "" for r in frame.where("doc_id % 20 = 3").collect()}  # scored one by one here; the query scores all
    machine = toxicity.train(frame, labels)
    assert len(machine.w) and np.abs(machine.v).max() > 0.05  # pairs have weights
    ids, texts = list(docs), list(docs.values())
    slots = {}
    for rows, row, slot in toxicity.terms(pa.array(texts)):
        for i in range(rows):
            slots[ids[len(slots)]] = slot[row == i].tolist()
    # each distinct word and each distinct beginning of a longer one is a term
    for i, own in list(slots.items())[:60]:
        words = set(re.findall(rb"[a-z0-9\x80-\xff]+", docs[i].encode().lower() if docs[i].isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), docs[i].encode())))
        leads = {(n, w[:n]) for w in words for n in toxicity.PREFIXES if len(w) > n}
        assert 0.98 * (len(words) + len(leads)) <= len(own) <= len(words) + len(leads)  # a few share a slot
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, sf).collect()}
    for i in docs:
        want = plain_score(machine, slots[i])
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].predicted == int(got[i].score >= 0.3)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_op9_on_rows_that_fitting_never_saw(spark):
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "toxic")
    rows = [(r.toxic, r.predicted) for r in queries.op9_toxicity(spark, big).where("held_out").join(labels, "doc_id").collect()]
    n = Counter(rows)
    caught, false = n[1, 1] / (n[1, 1] + n[1, 0]), n[0, 1] / (n[0, 1] + n[0, 0])
    assert caught > 0.85 and false < 0.02, (n, caught, false)


def test_op10(spark, byte_ids):
    parts, sequences = defaultdict(list), defaultdict(list)
    for x in queries.op10_packing(spark, SF).collect():
        parts[x.doc_id].append((x.start, x.length, x.ids_crc32, x.doc_tokens))
        sequences[x.sequence_id].append((x.offset, x.length))
    want = {}
    for i, ids in byte_ids.items():
        own = ids + [1]
        want[i] = [(s, len(own[s : s + 2048]), zlib.crc32(np.array(own[s : s + 2048], "<u4").tobytes()), len(own)) for s in range(0, len(own), 2048)]
    assert {i: sorted(p) for i, p in parts.items()} == want
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    used = sum(n for own in sequences.values() for _, n in own)
    assert len(sequences) <= -(-used // 2048) + 1


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_on_every_code_point(path):
    """Each character alone, within a word, at its ends, and beside spaces gives the library's own ids."""
    library, own = Tokenizer.from_file(path), tokens.Encoder(path)
    points = [c for c in [*range(0x40000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 16_384):
        texts = [f"a{chr(c)}b {chr(c)}1 {chr(c)}" for c in points[at : at + 16_384]]
        want = [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
        assert own.count(texts) == list(map(len, want))


def test_only_an_absent_subpackage_is_hidden(tmp_path, monkeypatch):
    """The entry goes on without the subpackage or the pipeline, and stops at an import that is broken inside them."""
    import pathlib
    import shutil
    import subprocess

    repo = pathlib.Path(queries.__file__).parents[2]
    say = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"

    def run(name, change):
        at = tmp_path / name
        shutil.copytree(repo, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
        change(at)
        return subprocess.run([sys.executable, "-B", "-c", say], cwd=at, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(at)})

    whole = run("whole", lambda at: None)
    gone = run("gone", lambda at: (shutil.rmtree(at / "stratagraph/llm"), (at / "corpus_pipeline.py").unlink()))
    half = run("half", lambda at: shutil.rmtree(at / "stratagraph/llm"))
    broken = run("broken", lambda at: (at / "stratagraph/llm/lines.py").write_text("import no_such_module\n"))
    n = int(whole.stdout.split()[0])
    assert whole.stdout.split()[1] == "True" and gone.stdout.split() == half.stdout.split() == [str(n - 11), "False"]
    assert broken.returncode and "no_such_module" in broken.stderr
