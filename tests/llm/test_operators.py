import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratagraph.llm import components, counts, decontamination, embeddings, lines, matrices, minhash, packing, sharding, substrings, tokens, toxicity, wordhash
from stratagraph.llm.scratch import Scratch

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, row string, key int, score double"


def docs(spark, rows):
    """Rows (doc_id, text), with more columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", "r", 1, 0.5) for i, t in rows], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") + str(r.randrange(400)) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (None, "one"), (6, "x" * 300_000), (7, "größe ß   日本"), (7, "größe ß   日本"), (8, "a b c d e"), (9, "A b\tc\nd e")]


def groups(edges, nodes):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        low[b] = a
    return {n: find(n) for n in nodes}


def test_words_match_regex():
    r = random.Random(1)
    texts = ["".join(r.choice("aB \t\n.é\x0b9-") for _ in range(r.randrange(60))) for _ in range(300)] + [None, "", "z" * 5000]
    for table, pattern in ((wordhash.white_space_words(True), rb"[^\x20\x09-\x0D]+"), (wordhash.alphanumeric_words(), rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, offsets = wordhash.buffers(pa.array(texts))
        h, start, end, first = wordhash.words(data, offsets, table)
        said = defaultdict(set)
        for i, t in enumerate(texts):
            low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
            own = re.findall(pattern, low)
            assert first[i + 1] - first[i] == len(own)
            for w, x in zip(own, h[first[i] : first[i + 1]].tolist()):
                said[x].add(w)
        assert all(len(v) == 1 for v in said.values())
    assert (wordhash.grams(h, 7)[:40] == wordhash.gram_at(h, np.arange(40), 7)).all()


def test_words_over_segments(monkeypatch):
    texts = pa.array([prose(i, 50) for i in range(40)] + ["q" * 900])
    table = wordhash.white_space_words(False)
    whole = wordhash.words(*wordhash.buffers(texts), table)
    monkeypatch.setattr(wordhash, "SEGMENT", 64)
    assert all((a == b).all() for a, b in zip(whole, wordhash.words(*wordhash.buffers(texts), table)))


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(50), 100 + r.randrange(50)) for _ in range(40)] + [(500, 600 + i) for i in range(200)] + [(7, 7)]
    got = {x.node: x.component for x in components.components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(edges, {x for e in edges for x in e})
    assert {n: got.get(n, n) for n in want} == want
    assert components.components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k=5):
    own = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else {tuple(own)} if own else set()


def test_minhash(spark):
    r, rows = random.Random(5), []
    for family in range(6):  # drifting copies: links chain, and ends of a chain are far apart
        words = prose(family, 120).split()
        for j in range(25):
            for _ in range(r.choice([0, 0, 1, 2])):
                words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
            rows.append((100 * family + j + 1000, " ".join(words)))
    passage = prose(99, 40)
    rows += [(3000 + i, passage + " " + prose(1000 + i, 150)) for i in range(40)] + [(4000 + i, prose(7, 30)) for i in range(20)]
    sets = {i: shingles(t) for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and sets[a]]
    want = groups(edges, sets)
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_minhash_edges(spark):
    got = sorted((tuple(x) for x in minhash.near_duplicates(docs(spark, EDGE)).collect()), key=str)
    assert (4, 1, 4, True) in got and (5, 1, 4, False) in got and (None, 1, None, True) in got
    assert got.count((7, 1, 7, True)) == 2 and (2, 0, 2, True) in got and (9, 1, 8, False) in got
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def repeats_of(units, length):
    """Marks of units that an earlier run covers, by brute force; units: id -> list."""
    seen, out = set(), {}
    for i in sorted(units):
        own = units[i]
        out[i] = [False] * len(own)
        for at in range(len(own) - length + 1):
            run = tuple(own[at : at + length])
            if run in seen:
                out[i][at : at + length] = [True] * length
            seen.add(run)
    return out


def test_substrings(spark):
    r, rows, pool = random.Random(6), [], [prose(50 + i, 24 + i).split() for i in range(12)]
    for i in range(120):
        words = prose(200 + i, r.randrange(5, 60)).split()
        for _ in range(r.randrange(3)):
            at, part = r.randrange(len(words) + 1), r.choice(pool)
            cut = r.randrange(0, 8)
            words[at:at] = part[cut : cut + r.randrange(15, 30)]
        rows.append((i, " ".join(words)))
    rows += [(500, "a " * 90), (501, rows[3][1]), (502, " ".join(pool[0][:19])), (503, " ".join(pool[1][:20]))]
    units = {i: t.encode().split() for i, t in rows}
    marks = repeats_of(units, 20)
    got = {x.doc_id: x for x in substrings.dedup_substrings(docs(spark, rows)).collect()}
    for i, own in units.items():
        kept = b" ".join(w for w, m in zip(own, marks[i]) if not m).decode()
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(own), sum(marks[i]), kept)
    assert sum(map(sum, marks.values())) > 500


def test_substrings_edges(spark):
    long = prose(9, 25)
    got = [tuple(x) for x in substrings.dedup_substrings(docs(spark, [*EDGE, (20, long), (20, long), (None, long), (21, long)])).collect()]
    assert (1, 0, 0, "") in got and (6, 1, 0, "x" * 300_000) in got
    assert (None, 25, 0, long) in got  # no id counts as the least
    assert got.count((20, 25, 25, "")) == 2 and (21, 25, 25, "") in got
    assert substrings.dedup_substrings(docs(spark, [])).count() == 0


def test_lines(spark):
    r, rows = random.Random(8), []
    pool = [prose(70 + i, 4) for i in range(15)]
    for i in range(150):
        own = [prose(900 + 20 * i + j, 3) for j in range(r.randrange(1, 6))]
        for _ in range(r.randrange(3)):
            at, cut = r.randrange(len(own) + 1), r.randrange(10)
            own[at:at] = pool[cut : cut + r.randrange(1, 6)]
        if r.random() < 0.3:
            own.insert(r.randrange(len(own)), "  ")
        rows.append((i, "\n".join(own)))
    split = {i: t.split("\n") for i, t in rows}
    solid = {i: [j for j, x in enumerate(own) if x.split()] for i, own in split.items()}
    marks = repeats_of({i: [tuple(split[i][j].split()) for j in solid[i]] for i in split}, 3)
    got = {x.doc_id: x for x in lines.dedup_lines(docs(spark, rows)).collect()}
    for i, own in split.items():
        gone = {j for j, m in zip(solid[i], marks[i]) if m}
        text = "" if len(gone) == len(solid[i]) else "\n".join(x for j, x in enumerate(own) if j not in gone)
        assert (got[i].report.n_lines, got[i].report.n_removed, got[i].text, got[i].row) == (len(solid[i]), len(gone), text, "r")
    assert sum(map(sum, marks.values())) > 50
    edge = lines.dedup_lines(docs(spark, EDGE)).collect()
    assert len(edge) == len(EDGE) and any(x.doc_id == 1 and x.text is None for x in edge)
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_decontamination(spark, monkeypatch):
    items = [(i, prose(i, 25)) for i in range(8)] + [(8, "Short item here"), (9, ""), (10, None), (None, prose(77, 30)), (3, prose(11, 12))]
    r, rows = random.Random(9), []
    for i in range(100):
        words = prose(300 + i, r.randrange(3, 50)).split()
        if r.random() < 0.5:
            part = (r.choice(items)[1] or "").upper().split()
            at, cut = r.randrange(len(words) + 1), r.randrange(10)
            words[at:at] = part[cut : cut + r.randrange(5, 20)]
        rows.append((i, ", ".join(words) + ("\nshort ITEM, here" if i % 9 == 0 else "")))
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    windows = defaultdict(set)
    for i, t in items:
        own = cut(t)
        n = min(10, len(own))
        for at in range(len(own) - n + 1) if n and i is not None else ():
            windows[tuple(own[at : at + n])].add(str(i))
    want = {}
    for i, t in rows:
        own, hit, found = cut(t), set(), set()
        for n in {len(w) for w in windows}:
            for at in range(len(own) - n + 1):
                if tuple(own[at : at + n]) in windows:
                    found |= windows[tuple(own[at : at + n])]
                    hit |= set(range(at, at + n))
        want[i] = (len(own), len(hit), sorted(found))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 300):  # one index, and several
        monkeypatch.setattr(decontamination, "INDEX_BYTES", size)
        got = decontamination.contamination(docs(spark, rows), bench).collect()
        assert {x.row.doc_id: (x.n_words, x.n_hit, x["items"]) for x in got} == want
    assert sum(n > 0 for _, n, _ in want.values()) > 20
    assert decontamination.contamination(docs(spark, EDGE), bench.limit(0)).where("n_hit > 0").isEmpty()
    assert decontamination.contamination(docs(spark, []), bench).isEmpty()


TRICKY = ["", " ", "a  b", "a \n b", "\n\na", "x\ty", "it's we'll 'd", "<|endoftext|> a<|endoftext|>", " lead", "trail ", "line\nnext line\n", "é日本 ñ", "a  b", "$$$ ### 12 345x", "Σίσυφος ΟΔΟΣ", "é ﬁ", "tab\r\nnl", "z" * 3000]


def test_encoder_equals_library():
    r = random.Random(4)
    texts = TRICKY + ["".join(r.choice("ab' \n.\t9é<|") for _ in range(r.randrange(40))) for _ in range(1500)] + [prose(i, 50) for i in range(20)]
    for path in (BYTE, WORD):
        t, e = Tokenizer.from_file(path), tokens.Encoder(path)
        want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want
        assert e.count(texts) == [len(x) for x in want]
        assert e.count(texts) == [len(x) for x in want]  # from the cache
    assert tokens.Encoder(BYTE).spaced and tokens.Encoder(WORD).parted


def test_token_counts_cache(spark, tmp_path):
    rows = [*EDGE, *((100 + i, prose(i % 5, 30)) for i in range(20))]
    cache, t = f"file://{tmp_path}/cache", Tokenizer.from_file(WORD)
    want = sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows), key=str)
    for _ in range(2):
        got = counts.token_counts(docs(spark, rows), WORD, cache).collect()
        assert sorted(map(tuple, got), key=str) == want
        assert spark.read.parquet(cache).count() == len({x or "" for _, x in rows})  # the second run adds nothing
    counts.token_counts(docs(spark, [(1, "new text")]), BYTE, cache).collect()
    assert spark.read.parquet(cache).select("version").distinct().count() == 2
    assert counts.token_counts(docs(spark, []), WORD).count() == 0


def test_packing(spark):
    rows = [*EDGE, *((100 + i, prose(i, 40 * i)) for i in range(40))]
    t = Tokenizer.from_file(BYTE)
    got = packing.pack(docs(spark, rows), BYTE, capacity=256).collect()
    ids = defaultdict(list)
    sequences = defaultdict(list)
    for x in got:
        own = np.frombuffer(x.ids, "<u4")
        assert zlib.crc32(x.ids) == x.ids_crc32 and len(own) == x.length
        ids[x.doc_id].append((x.start, x.doc_tokens, own))
        sequences[x.sequence_id].append((x.offset, x.length))
    for i, text in rows:
        if i in (7,):  # twice
            continue
        want = t.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(ids[i], key=lambda p: p[0])
        assert np.concatenate([p[2] for p in parts]).tolist() == want and {p[1] for p in parts} == {len(want)}
        assert [p[0] for p in parts] == np.cumsum([0, *(len(p[2]) for p in parts)])[:-1].tolist()
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts)])[:-1].tolist() and sum(p[1] for p in parts) <= 256
    assert sum(x.length for x in got) / (256 * len(sequences)) > 0.97
    assert packing.pack(docs(spark, []), BYTE).count() == 0


def test_least_slack_is_best_for_the_longest():
    r = random.Random(2)
    for _ in range(60):
        have = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(6)}
        chosen, times = next(packing.least_slack(have, 32))
        longest = max(have)
        pool = [n for n, c in have.items() for _ in range(c - (n == longest))]
        best = max(sum(c) for k in range(len(pool) + 1) for c in itertools.combinations(pool, k) if sum(c) <= 32 - longest)
        assert sum(n * k for n, k in chosen.items()) == longest + best
        assert times >= 1 and all(k * times <= have[n] for n, k in chosen.items())


def test_best_fit():
    r = random.Random(3)
    sizes = [r.randrange(1, 65) for _ in range(500)]
    window, offset = matrices.best_fit(sizes, 64)
    free: list[int] = []
    want = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):  # the plain rule
        fits = [(f, -w) for w, f in enumerate(free) if f >= sizes[i]]
        w = -min(fits)[1] if fits else len(free)
        if not fits:
            free.append(64)
        free[w] -= sizes[i]
        want[i] = free[w]
    ends = defaultdict(int)
    for w, o, n in zip(window, offset, sizes):
        assert o + n <= 64
        ends[w] += n
    assert sorted(64 - e for e in ends.values()) == sorted(free)


def test_matrices(spark):
    rows = [*((i, x) for i, x in EDGE if i not in (6, 7)), *((100 + i, prose(i, 30 * i)) for i in range(20))]
    t, got = Tokenizer.from_file(BYTE), defaultdict(dict)
    for x in matrices.token_matrices(docs(spark, rows), BYTE, capacity=128).collect():
        ids, pos, ends = np.frombuffer(x.ids, "<u2"), np.frombuffer(x.position_ids, "<u2"), x.cu_seqlens
        assert len(ids) == len(pos) == 128 and ends[0] == 0 and ends[-1] == x.n_tokens
        for d, s, a, b in zip(x.doc_ids, x.starts, ends, ends[1:]):
            got[d][s] = ids[a:b].tolist()
            assert pos[a:b].tolist() == list(range(b - a))
        assert (ids[x.n_tokens :] == 50256).all() and pos[x.n_tokens :].tolist() == list(range(128 - x.n_tokens))
    for i, text in rows:
        assert sum((got[i][s] for s in sorted(got[i])), []) == t.encode(text or "", add_special_tokens=False).ids + [50256]
    assert matrices.token_matrices(docs(spark, []), BYTE).count() == 0


def test_embeddings(spark, monkeypatch):
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 16))
    x = np.concatenate([centres[r.integers(30, size=400)] + r.normal(size=(400, 16)) * r.choice([0.02, 0.15, 0.3], size=(400, 1)), r.normal(size=(200, 16))]).astype(np.float32)
    x[50:60] = x[50]
    odd = [(1001, None), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, None] + [0.0] * 14), (1005, [1.0] * 8), (1006, [2.0] * 8), (None, [1.0] * 16), (1007, [float("inf")] * 16), (1008, [])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    low = groups(zip(*map(np.ndarray.tolist, np.nonzero(near))), range(len(x)))
    want = {i: (int(near[i].sum()), low[i], low[i] == i) for i in range(len(x))}
    want |= {1001: (0, 1001, True), 1002: (0, 1002, True), 1003: (0, 1003, True), 1004: (0, 1004, True), 1005: (1, 1005, True), 1006: (1, 1005, False), 1007: (0, 1007, True), 1008: (0, 1008, True), None: (0, None, True)}
    monkeypatch.setattr(embeddings, "CELL_ROWS", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {g.vec_id: (g.n_links, g.component_id, g.kept) for g in got} == want
    assert near.sum() > 500
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sharding(spark, tmp_path):
    rows = [*EDGE[:5], *((100 + i, "y" * (i % 97 * 10)) for i in range(3000))]
    folder = f"file://{tmp_path}/map"
    got = sharding.shard(docs(spark, rows), 8, folder).collect()
    by = defaultdict(list)
    for x in got:
        by[x.shard].append(x)
    assert all(sorted(x.slot for x in own) == list(range(len(own))) for own in by.values())
    sizes = [sum(x.size for x in own) for own in by.values()]
    assert len(by) == 8 and max(sizes) - min(sizes) < 0.01 * max(sizes)
    text = {i: (t or "").encode() for i, t in rows}
    assert all(x.size == len(text[x.doc_id]) + 1 and x.text_crc32 == zlib.crc32(text[x.doc_id]) for x in got)
    more = sharding.shard(docs(spark, [*rows, *((10_000 + i, "z" * 400) for i in range(500))]), 8, folder, version=2, previous=1).collect()
    was = {x.doc_id: x.shard for x in got}
    moved = sum(was[x.doc_id] != x.shard for x in more if x.doc_id in was)
    assert moved < 0.1 * len(rows)  # an edit, not a new map
    load = defaultdict(int)
    for x in more:
        load[x.shard] += x.size
    assert max(load.values()) < 1.02 * min(load.values())
    with pytest.raises(Exception):
        sharding.write_map(spark, folder, 1, {}, {})
    assert sharding.shard(docs(spark, [])).count() == 0


def test_toxicity(spark):
    r, rows, labels = random.Random(1), [], []
    for i in range(1500):
        words = prose(i, r.randrange(5, 80)).split()
        bad = r.random() < 0.2
        pair = r.random()
        # neither word alone tells; both together do
        words += ["grin"] * (bad or pair < 0.2) + ["folk"] * (bad or 0.2 < pair < 0.4)
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(bad)))
    rows += [(9001, None), (9002, ""), (None, "grin folk"), (9003, "folk"), (9004, "grin " * 5000)]
    labels += [(9001, 0, None), (9002, 1, 7), (None, 0, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, rows), told).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    known = {i: t for i, _, t in labels}
    held = [(x.score >= 0.3, known[x.doc_id]) for x in got if x.held_out and x.doc_id is not None and x.doc_id < 9000]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got if x.doc_id is not None)
    assert np.mean([a == b for a, b in held]) > 0.97
    scores = {x.doc_id: x.score for x in got}
    assert scores[9001] == scores[9002] < 0.3 and scores[None] > 0.5 > scores[9003]
    same = {x.score for x in toxicity.toxicity(docs(spark, rows), told.limit(0)).collect()}
    assert len(same) == 1
    assert toxicity.toxicity(docs(spark, []), told).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = prose(1, 200)
    rows = [(i, prose(1000 + i, 80).replace(" ", "\n", 5)) for i in range(60)]
    rows += [(100, base), (101, base.replace("a", "a", 1) + " end"), (102, base), (103, prose(3, 30) + " " + prose(500, 30)), (104, None), (105, "")]
    labels = [(i, 1, 0) for i in range(60)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(500, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    kept = {x.doc_id for x in got.collect()}
    assert kept == {*range(60), 100, 104, 105}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "packing"]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {int(m[1]) for m in map(re.compile(r"op(\d+)_").match, names) if m} == set(range(1, 11))


def test_query_digest(spark):
    from stratagraph.llm import queries

    out = {x.doc_id: x.kept_sha256 for x in queries.op2_substrings(spark, "/root/testdata/sf0.001").select("doc_id", "kept_sha256").collect()}
    docs_ = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    marks = repeats_of({d.doc_id: (d.text or "").encode().split() for d in docs_}, 20)
    for d in docs_:
        kept = b" ".join(w for w, m in zip((d.text or "").encode().split(), marks[d.doc_id]) if not m)
        assert out[d.doc_id] == hashlib.sha256(kept).hexdigest()
