"""Rows that share an id or have none: by brute force, in many groups, in linear time."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratagraph.llm import lines, matrices, packing, repeats, scratch, sharding, substrings, toxicity

BYTE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") + str(r.randrange(400)) for _ in range(n))


def rows_of(units):
    """Rows whose ids are null, shared or their own, with runs in common."""
    r, out = random.Random(9), []
    pool = [units(600 + i, 40) for i in range(4)]
    for i in range(90):
        own = units(i, r.randrange(1, 30))
        if r.random() < 0.6:
            at, part = r.randrange(len(own) + 1), r.choice(pool)
            cut = r.randrange(10)
            own[at:at] = part[cut : cut + r.randrange(2, 30)]
        out.append((r.choice([None, None, 3, 3, 8, 100 + i]), own))
    same = units(700, 25)
    return out + [(None, same)] * 9 + [(8, same)] * 7 + [(8, [])] * 3


def marks_of(rows, length):
    """Equal runs at one (id, position) are no repeats of each other; no id counts as the least."""
    key = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, own in rows:
        for at in range(len(own) - length + 1):
            run = tuple(own[at : at + length])
            first[run] = min(first.get(run, (key(i), at)), (key(i), at))
    out = []
    for i, own in rows:
        marked = [False] * len(own)
        for at in range(len(own) - length + 1):
            if first[tuple(own[at : at + length])] != (key(i), at):
                marked[at : at + length] = [True] * length
        out.append(marked)
    return out


@pytest.mark.parametrize("crowded", [False, True])
def test_repeats(spark, monkeypatch, crowded):
    if crowded:  # equal rows over several buckets
        monkeypatch.setattr(repeats, "SHARED_ROWS", 2)
        monkeypatch.setattr(repeats, "DOC_BYTES", 200)
    words = rows_of(lambda seed, n: prose(seed, n).split())
    got = substrings.dedup_substrings(spark.createDataFrame([(i, " ".join(x)) for i, x in words], DOCS)).collect()
    want = Counter((i, len(x), sum(m), " ".join(w for w, gone in zip(x, m) if not gone)) for (i, x), m in zip(words, marks_of(words, 20)))
    assert Counter(map(tuple, got)) == want and sum(x[2] for x in want) > 100
    text = rows_of(lambda seed, n: [f"l{seed}-{k} x" for k in range(n)])
    frame = spark.createDataFrame([(i, "\n".join(x)) for i, x in text], DOCS)
    for gram, window in ((2, 2), (1, 1), (2, 3)):
        got = lines.dedup_lines(frame, gram, window).collect()
        want = Counter((i, len(x), sum(m), "\n".join(w for w, gone in zip(x, m) if not gone)) for (i, x), m in zip(text, marks_of(text, gram + window - 1)))
        assert Counter((x.doc_id, x.report.n_lines, x.report.n_removed, x.text) for x in got) == want
    if crowded:
        assert repeats._crowded(frame.withColumn("row_key", frame.doc_id * 0 + 7), 16)


def test_rows_without_id_take_no_longer(spark, tmp_path):
    text = prose(1, 60)
    took = {}
    for name, ids in (("own", range(20_000)), ("none", [None] * 20_000), ("one", [5] * 20_000)):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, text) for i in ids], DOCS).write.parquet(path)
        for _ in range(2):
            began = time.perf_counter()
            out = substrings.dedup_substrings(spark.read.parquet(path)).groupBy("n_removed").count().collect()
            took[name] = time.perf_counter() - began
        assert {r.n_removed: r["count"] for r in out} == ({0: 1, 60: 19_999} if name == "own" else {0: 20_000})
    assert took["none"] < 2 * took["own"] + 2 and took["one"] < 2 * took["own"] + 2


def test_packing_deals_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 20_000)
    rows = [(None, prose(1, 30))] * 600 + [(4, prose(2, 25))] * 300 + [(i, prose(i, 90)) for i in range(10, 40)]
    frame = spark.createDataFrame(rows, DOCS)
    t = Tokenizer.from_file(BYTE)
    ids = {x: t.encode(x, add_special_tokens=False).ids + [1] for _, x in set(rows)}
    want = Counter(zlib.crc32(np.array(ids[x], "<u4").tobytes()) for _, x in rows)
    got = packing.pack(frame, BYTE).collect()
    assert Counter(x.ids_crc32 for x in got) == want
    by = Counter(x.sequence_id >> 32 for x in got)
    assert len(by) > 4 and max(by.values()) < 2 * len(got) / len(by)  # though two thirds of the rows have no id and one text
    windows = matrices.token_matrices(frame, BYTE).collect()
    parts = Counter(tuple(np.frombuffer(x.ids, "<u2")[a:b].tolist()) for x in windows for a, b in zip(x.cu_seqlens, x.cu_seqlens[1:]))
    assert parts == Counter(tuple(ids[x][:-1] + [50256]) for _, x in rows)


def test_ids_must_fit_their_type(spark):
    frame = spark.createDataFrame([(1, "x")], DOCS)
    for call in (lambda: packing.pack(frame, BYTE, end_id=70_000, stored="<u2"), lambda: matrices.token_matrices(frame, BYTE, pad_id=65_536), lambda: packing.pack(frame, BYTE, stored="u1")):
        with pytest.raises(ValueError, match="does not fit"):
            call()
    assert packing.pack(frame, BYTE, end_id=70_000).count() == 1


def test_matrices_as_files(spark, tmp_path):
    rows = [(i, prose(i, 40 * i)) for i in range(30)] + [(90, None), (91, "")]
    made = matrices.token_matrices(spark.createDataFrame(rows, DOCS), BYTE, capacity=256)
    folder = f"file://{tmp_path}/out"
    for _ in range(2):  # a second write leaves the same files
        parts = matrices.write_matrices(made, folder, 256).collect()
    found = [x for p in parts for x in zip(*matrices.read_part(folder, p.part))]
    want = {(bytes(x.ids), bytes(x.position_ids), tuple(x.cu_seqlens)) for x in made.collect()}
    assert {(a.tobytes(), b.tobytes(), tuple(c.tolist())) for a, b, c in found} == want
    assert sum(p.windows for p in parts) == len(found) == made.count()
    assert matrices.write_matrices(made.limit(0), f"file://{tmp_path}/none", 256).count() == 0


def test_shards_of_rows_without_id(spark):
    rows = [(None, "same text")] * 4000 + [(7, "other")] * 50 + [(i, "y" * i) for i in range(100, 160)] + [(1, None), (2, ""), (3, "z" * 200_000)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS), 4).collect()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for x in got:
        by[x.shard].append(x.slot)
    assert all(sorted(own) == list(range(len(own))) for own in by.values())
    assert max(Counter(x.virtual_slot for x in got if x.doc_id is None).values()) < 50


def test_fit_is_bounded_where_rows_share_a_labelled_id(spark, monkeypatch):
    held = []
    monkeypatch.setattr(toxicity, "fit", lambda slots, label: held.append(label) or "machine")
    rows = [(1, f"text {i}") for i in range(500)] + [(1, "text 1")] * 300 + [(3, "other"), (3, "more")]
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    toxicity.train(docs, labels, rows=40)
    toxicity.train(docs, labels, rows=10_000)
    free = [i for i in (1, 3) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(held[0]) == min(40, len(held[1])) and len(held[1]) == 500 * (1 in free) + 2 * (3 in free)


def test_scratch_goes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    folders = lambda: [x.name.rsplit("-", 1)[0] for x in (tmp_path / "shared").iterdir() if x.is_dir()]
    own = scratch.Scratch(spark, "some-name")
    own.save(spark.range(3), "t")
    scratch.Scratch(spark, "other").save(spark.range(3), "t")
    (tmp_path / "shared" / "not-ours").mkdir()
    own.close()
    assert sorted(folders()) == ["not", "other"]
    assert scratch.sweep(spark, 1) == 0 and scratch.sweep(spark, -1) == 1
    assert folders() == ["not"]


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Context:
    """A session without ``spark.checkpoint.dir``, local or not."""

    def __init__(self, local):
        self.conf, self.sparkContext, self._jsc, self._local = Conf(), self, self, local

    def getConf(self):
        return self.conf

    def sc(self):
        return self

    def isLocal(self):
        return self._local


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Context(False))
    assert scratch.shared_folder(Context(True)).startswith("file://")
