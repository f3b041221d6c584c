"""Near copies against brute force: exact lists, templates, and groups whose links chain."""

import itertools
import random
import re

import pytest

from stratagraph.llm import minhash

DOCS = "doc_id long, text string, sketch string, own string, v int, c int"


def prose(seed, n):
    r = random.Random(seed)
    return [r.choice("abcdefghij") + str(r.randrange(400)) for _ in range(n)]


def shingles(text, k=5):
    own = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else {tuple(own)} if own else set()


def components(sets, num, den):
    low = {i: i for i in sets}
    edges = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(low[a], low[b])
            if low[a] != least or low[b] != least:
                low[a] = low[b] = least
                changed = True
    return low, len(edges)


def rows():
    """Copies of templates with own middles, some over and most under the threshold, and families that drift."""
    r, out = random.Random(4), []
    for t, share in enumerate((60, 80, 92, 110)):
        shared = prose(t, share)
        for i in range(40):
            own = prose(1000 * t + i, 20 if share > 90 and i % 4 else 45)
            if i % 5 == 0 and i:
                own = own_before[: len(own) - 1] + own[-1:]
            own_before = own
            out.append((100 * t + i, " ".join(shared + own)))
    words = prose(77, 100)
    for j in range(30):
        words[r.randrange(100)] = f"n{j}"
        out.append((900 + j, " ".join(words)))
    return out + [(2000, None), (2001, ""), (2002, "two words"), (2003, "Two  WORDS"), (None, "two words")]


@pytest.mark.parametrize("exact, num", [(False, 80), (True, 85)])
def test_templates_and_chains(spark, exact, num):
    found = rows()
    sets = {i: shingles(t) for i, t in found if i is not None}
    low, links = components(sets, num, 100)
    frame = spark.createDataFrame([(i, t, "s", "o", 1, 2) for i, t in found], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame, num=num, exact=exact).collect()}
    assert got.pop(None) == (1, None, True)
    assert got == {i: (len(sets[i]), low[i], low[i] == i) for i in sets}
    assert links > 50


def test_templates_leave_each_others_lists(spark, monkeypatch):
    """Documents that share three fifths of their words, and no more, are not compared in blocks."""
    shared, compared = prose(1, 180), []
    members = minhash._blocks
    monkeypatch.setattr(minhash, "_blocks", lambda rows, scratch: compared.append(rows.count()) or members(rows, scratch))
    found = [(i, " ".join(shared + prose(i + 10, 120))) for i in range(400)]
    frame = spark.createDataFrame([(i, t, "s", "o", 1, 2) for i, t in found], DOCS)
    assert minhash.near_duplicates(frame).where("kept").count() == 400
    assert sum(compared) < 40
