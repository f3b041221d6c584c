"""Cases that a stage or operator once left out."""

import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stratagraph.llm import lines, substrings, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") + str(r.randrange(400)) for _ in range(n))


def jaccard(a, b, k=5):
    a, b = ({tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_dedup_stage_links_from_080(spark):
    base = prose(1, 120)
    at_84, at_78 = (re.sub(r"\S+", lambda m, n=iter(range(200)), s=spots: f"new{m.start()}" if next(n) in s else m[0], base) for spots in ((30, 60), (30, 60, 90)))
    assert 0.80 <= jaccard(base, at_84) < 0.85 and jaccard(base, at_78) < 0.80
    rows = [(1, base), (2, at_84), (3, prose(2, 120)), (4, prose(3, 40)), (5, prose(4, 120))]
    assert {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "").collect()} == {1, 3, 4, 5}
    assert corpus_pipeline.drop_near_copies(spark, docs(spark, [(1, base), (2, at_78)]), "").count() == 2


def test_line_dedup_stage_finds_single_lines(spark):
    passage, short, two = prose(11, 50), "all rights reserved", [prose(12, 12), prose(13, 8)]
    own = [prose(20 + i, 30) for i in range(12)]
    rows = [
        (1, "\n".join([own[0], passage, own[1], short])),
        (2, "\n".join([own[2], "", passage])),  # a passage of one line
        (3, "\n".join([short, own[3], own[4], own[5]])),
        (4, passage.replace(" ", "  ")),  # nothing else
        (5, "\n".join([*two, own[6]])),
        (6, "\n".join([own[7], *two])),  # and of two
        (7, "\n".join([own[8], own[9], own[8]])),  # within a document
        (8, own[10] + "\n" + own[11]),
    ]
    got = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.drop_repeated_lines(spark, docs(spark, rows), "").collect()}
    want = dict(rows) | {2: own[2] + "\n", 3: "\n".join(own[3:6]), 6: own[7], 7: own[8] + "\n" + own[9]}
    assert got == {i: (t, len(t)) for i, t in want.items() if i != 4}


def test_encoder_keeps_nul():
    texts = ["x \0abc", "\0abc", "abc x", "\0", "x \0", "\0 \0abc", "a\0b \0\0c", "x\n\0abc", "abc"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        for turn in (texts, texts[::-1]):
            made, expect = tokens.Encoder(path), want if turn is texts else want[::-1]
            assert [np.frombuffer(x, "<u4").tolist() for x in made.encode(turn)] == expect
            assert made.count(turn) == [len(x) for x in expect]


def marks_of(rows, length):
    """Marks of units by brute force: equal runs at one (id, position) are no repeats of each other."""
    first = {}
    for i, own in sorted(rows, key=lambda r: r[0]):
        for at in range(len(own) - length + 1):
            first[tuple(own[at : at + length])] = min(first.get(tuple(own[at : at + length]), (i, at)), (i, at))
    out = []
    for i, own in rows:
        marked = [False] * len(own)
        for at in range(len(own) - length + 1):
            if first[tuple(own[at : at + length])] != (i, at):
                marked[at : at + length] = [True] * length
        out.append(marked)
    return out


def repeated_ids(length):
    """(id, units): ids that several rows of unlike length and text share."""
    known = [f"{w}x" for w in prose(31, 3 * length).split()]
    own = lambda seed, n: [f"{w}y{seed}" for w in prose(seed, n).split()]
    rows = [(1, known)]
    rows += [(2, own(32, 30) + known[:length]), (2, own(33, 30 + length // 2)), (3, own(34, 40))]  # ends beyond the shorter row
    rows += [(4, known[length:]), (4, own(35, 3 * length)), (4, own(36, 2))]  # inside an unlike row
    rows += [(5, own(37, 25)), (5, own(37, 25)), (6, own(37, 25) + known), (6, own(38, 3))]
    return rows + [(7, own(39, 20) + own(40, length)), (7, own(41, 4) + own(40, length)), (2**40, own(42, 50))]


def test_repeated_ids_of_unlike_texts(spark):
    rows = repeated_ids(20)
    got = substrings.dedup_substrings(docs(spark, [(i, " ".join(own)) for i, own in rows])).collect()
    want = [(i, len(own), sum(m), " ".join(w for w, x in zip(own, m) if not x)) for (i, own), m in zip(rows, marks_of(rows, 20))]
    assert sorted(map(tuple, got)) == sorted(want)
    rows = repeated_ids(3)
    for gram, window in ((2, 2), (1, 1)):
        got = lines.dedup_lines(docs(spark, [(i, "\n".join(own)) for i, own in rows]), gram, window).collect()
        want = [(i, len(own), sum(m), "\n".join(w for w, x in zip(own, m) if not x)) for (i, own), m in zip(rows, marks_of(rows, gram + window - 1))]
        assert sorted((x.doc_id, x.report.n_lines, x.report.n_removed, x.text) for x in got) == sorted(want)
