"""MinHash near-dedup with bottom-k sketches of one hash function.

1. Every document becomes its set of distinct ``words``-word shingles (64-bit
   hashes, made over whole Arrow buffers); the ``SKETCH`` least hashes are its
   bottom-k sketch. Documents with one and the same set form a class at once.
2. Inverted lists of retained values: values are ordered by how few classes
   retain them, and a class enters the lists of its rarest values only. Two
   sketches that share ``least_shared`` values must meet in such a list
   (prefix filter), so a passage that thousands of documents quote makes no
   long list. At the threshold fewer shared values have a probability below ``MISS``.
3. A list is not expanded into pairs. All members of a list meet its least member,
   the pivot. Classes in lists whose other members are not all linked to one pivot are
   then listed anew, by the rarest shingles of their full sets: a pair at the threshold
   shares one of the rarest ``n - ceil(t * n) + 1`` of each, so documents that only have
   a template in common leave each other's lists. These lists have their pivots too.
4. Classes that still share a list but no pivot form clusters; the members of a cluster
   outside its largest group meet all others in blocks, one pair of blocks a
   task, which gives an edge per linked document, never the pairs.
5. Pairs with pivots pass the union-sketch estimate; all links are
   verified by the exact Jaccard value of the full sets.

With ``exact``, step 2 lists all classes by their full sets, and no pair is left to
chance or to the estimate.

Texts cross the network once, and only sets of classes in lists are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .components import components
from .memory import released, released_group
from .scratch import Scratch

SKETCH = 32
#: Probability with which a pair right at the threshold may share fewer sketch values than asked for.
MISS = 1e-6
#: Classes, and shingles, of one block.
BLOCK, BLOCK_SHINGLES = 128, 1 << 18
#: Shingles that one product of a block counts.
COLUMNS = 4096

_SKETCHES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sketch", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])
_DDL = "doc_id long, n_shingles long, f1 long, f2 long, sketch array<long>"


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (63 bits) of each text."""
    table = wordhash.white_space_words(lower=True)
    data, offsets = wordhash.buffers(texts)
    for a, b in wordhash.slices(offsets):
        h, _, _, first = wordhash.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table)
        g = wordhash.grams(h, words) >> np.uint64(1)
        for i in range(b - a):
            at, to = first[i], first[i + 1]
            if to - at >= words:
                found = g[at : to - words + 1].copy()
                found.sort()
                yield found[np.concatenate([[True], found[1:] != found[:-1]])].view(np.int64)
            elif to > at:
                yield (wordhash.grams(h[at:to], int(to - at)) >> np.uint64(1)).view(np.int64)
            else:
                yield np.empty(0, np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, least = [], [], [], []
            for s in shingle_sets(batch.column("text"), words):
                n.append(len(s))
                u = s.view(np.uint64)
                f1.append(int(wordhash.mix(u).sum(dtype=np.uint64).view(np.int64)) if len(u) else 0)
                f2.append(int(wordhash.mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(u) else 0)
                least.append(s[:SKETCH].copy())  # a view would hold the whole set
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), _lists(least)], schema=_SKETCHES)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, held, size = batch.column("doc_id"), 0, [], 0
            for i, s in enumerate(shingle_sets(batch.column("text"), words)):
                held.append(s)
                size += len(s)
                if size >= 1 << 19 or i == len(ids) - 1:
                    own = [int(wordhash.mix(x.view(np.uint64)).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0 for x in held]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(held)), pa.array(own, pa.int64()), pa.array([len(x) for x in held], pa.int64()), _lists(held)], schema=_SETS)
                    at, held, size = i + 1, [], 0

    return run


def least_shared(num: int, den: int) -> int:
    """How many of the union's ``SKETCH`` least values a pair at the threshold shares, but for a chance of ``MISS``."""
    p, tail = num / den, 0.0
    for t in range(SKETCH + 1):
        tail += comb(SKETCH, t) * p**t * (1 - p) ** (SKETCH - t)
        if tail > MISS:
            return max(t, 1)
    return SKETCH


def _need(n: Column, num: int, den: int) -> Column:
    """Shared values that a class of n shingles must have with a partner; sets that fit a sketch are held whole."""
    return F.least(F.lit(least_shared(num, den)), F.ceil(n * num / den))


def _index(classes: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """(v, c, n): classes in the lists of the rarest values that they retain; lists of one are gone."""
    values = classes.where("n > 0").select("c", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    common = scratch.save(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "common")
    own = values.join(common, "v").groupBy("c").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # values that no other class retains are the rarest, so they fill the prefix first
    take = (F.col("k") - _need(F.col("n"), num, den) + 1) - (F.col("k") - F.size("vs"))
    rows = own.where(take > 0).select("c", "n", F.explode(F.slice("vs", 1, take.cast("int"))).alias("e")).select("e.v", "c", "n")
    return scratch.save(rows, "lists")


def _prefixes(members: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """members (c, n) -> (v, c, n): classes in the lists of the rarest shingles of their full sets; lists of one are gone."""
    own = members.select("c").join(sets.withColumnRenamed("doc_id", "c"), "c")
    # rows that share a doc_id have several sets
    values = own.select("c", "own", "n", F.explode("shingles").alias("v"))
    common = scratch.save(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "common")
    ranked = values.join(common, "v").groupBy("c", "own", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # shingles that no other class has are the rarest, so they fill the prefix first
    take = (F.col("n") - F.ceil(F.col("n") * num / den) + 1) - (F.col("n") - F.size("vs"))
    rows = ranked.where(take > 0).select("c", "n", F.explode(F.slice("vs", 1, take.cast("int"))).alias("e")).select("e.v", "c", "n")
    return scratch.save(rows, "prefixes")


def _estimated(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Keep pairs (a, b) whose share of matches among the least values of the union allows the threshold."""
    left = classes.select(F.col("c").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = classes.select(F.col("c").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    met = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return pairs.join(right, "b").join(left, "a").where(met >= _need(F.least("na", "nb"), num, den)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Keep pairs (a, b) whose full sets have den * |A & B| >= num * |A | B|. The last join is by ``a``, which may have very many partners; AQE splits it."""
    own = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(other, "b").join(own, "a").where(den * both >= num * (F.size("x") + F.size("y") - both)).select("a", "b")


def _blocks(members: DataFrame, scratch: Scratch) -> DataFrame:
    """members (cluster, label, c, n) -> with (i, j): the pairs of blocks in which a class meets the others of its cluster."""
    parts = members.groupBy("cluster", "label").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    main = parts.groupBy("cluster").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("main"), F.sum("m").alias("all"), F.sum("s").alias("sum"), F.max(F.struct("m", -F.col("label"), "s")).alias("top"))
    size = lambda m, s: F.ceil(F.greatest(m / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    main = main.select("cluster", "main", size(F.col("all") - F.col("top.m"), F.col("sum") - F.col("top.s")).alias("rest"), size(F.col("top.m"), F.col("top.s")).alias("core"))
    rows = members.join(scratch.save(main, "clusters"), "cluster")
    core = F.col("label") == F.col("main")
    own = F.when(core, F.col("rest") + F.pmod(F.xxhash64("c"), F.col("core")).cast("int")).otherwise(F.pmod(F.xxhash64("c"), F.col("rest")).cast("int"))
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(core, F.col("rest")).otherwise(F.col("rest") + F.col("core")) - 1)))
    return rows.select("cluster", "label", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _met(num: int, den: int):
    """Links between one pair of blocks: for each linked class the least class that links reach there."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, i, j = (k.as_py() for k in key)
        order = np.lexsort((np.asarray(table["c"]), np.asarray(table["block"])))
        table = table.take(pa.array(order))
        ids, label, block = (np.asarray(table[x]) for x in ("c", "label", "block"))
        column = table["shingles"].combine_chunks()
        size = np.diff(np.asarray(column.offsets))
        row, value = np.repeat(np.arange(len(ids)), size), np.asarray(column.flatten())
        known, place, times = np.unique(value, return_inverse=True, return_counts=True)
        # columns for the shingles that at least two classes have
        shared = np.cumsum(times > 1) - 1
        keep = times[place] > 1
        row, place = row[keep], shared[place[keep]]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        cut = int(np.searchsorted(block, j)) if i != j else 0
        left, right = (slice(0, len(ids)), slice(0, len(ids))) if i == j else (slice(0, cut), slice(cut, len(ids)))
        both = np.zeros((len(ids[left]), len(ids[right])), np.float32)
        for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
            a, b = np.searchsorted(place, [at, at + COLUMNS])
            has = np.zeros((len(ids), COLUMNS), np.float32)
            has[row[a:b], place[a:b] - at] = 1
            both += has[left] @ has[right].T
        near = den * both >= num * (size[left][:, None] + size[right][None] - both)
        near &= label[left][:, None] != label[right][None]
        a, b = np.nonzero(near)
        b = b + (0 if i == j else cut)
        low = np.arange(len(ids))
        while True:
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            new = new[new]
            if (new == low).all():
                break
            low = new
        on = np.flatnonzero(low != np.arange(len(ids)))
        return pa.table([pa.array(ids[on]), pa.array(ids[low[on]])], names=["a", "b"])

    return run


def _marked(lists: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of the lists that lie in several components, with their components."""
    marked = lists.join(labels.select(F.col("node").alias("c"), "component"), "c", "left").select("v", "c", "n", F.coalesce("component", "c").alias("label"))
    live = marked.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("c").alias("least")).where("lo < hi").select("v", "least")
    return scratch.save(marked.join(scratch.save(live, "live"), "v"), "open")


def _labels(links: DataFrame) -> DataFrame:
    """links (a: pivot, b) -> (node, component): nodes with one component are linked to it, which is all that the next step needs to know."""
    ends = links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")))
    return ends.groupBy("node").agg(F.min("component").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 85, den: int = 100, exact: bool = False) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, n_shingles, component_id, kept), a row for each row of docs.

    Documents with ``den * |A & B| >= num * |A | B|`` over their sets of distinct
    ``words``-word shingles are linked, ties included; component_id is the least doc_id that
    links reach. Words are lower-cased (A-Z) runs of bytes other than ASCII
    white space. Fewer words: the whole sequence is the one shingle. Null,
    empty or blank texts: no shingles, no links, kept. Rows that repeat a
    doc_id are one document with all their sets; each comes out, under its component. A null doc_id is its own
    component and kept, with no part in links. An empty table gives an empty
    one; other columns are ignored, whatever their names. A pair right at the threshold is missed with a
    probability below ``MISS``; with ``exact`` none is, at the cost of listing full sets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = scratch.save(docs.mapInArrow(released(_sketches(words)), _DDL), "sketches")
    named = base.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("c"), F.first("sketch").alias("sketch"))
    classes = scratch.save(classes.withColumnRenamed("n_shingles", "n"), "classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return scratch.save(docs.join(wanted, "doc_id", "left_semi").mapInArrow(released(_sets(words)), "doc_id long, own long, n long, shingles array<long>"), "sets")

    def met_pivots(lists: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(lists with their pivots, links with pivots)."""
        heads = lists.groupBy("v").agg(F.min(F.struct("c", "n")).alias("head"), F.count("*").alias("m")).where("m > 1")
        met = lists.join(scratch.save(heads.select("v", F.col("head.c").alias("a"), F.col("head.n").alias("na")), f"{name}-pivots"), "v")
        pairs = met.where(f"c <> a and {den} * least(n, na) >= {num} * greatest(n, na)").select("a", F.col("c").alias("b")).distinct()
        close = scratch.save(pairs if exact else _estimated(pairs, classes, num, den), f"{name}-close", "a")
        return met, scratch.save(_verified(close, sets, num, den), f"{name}-links", "a")

    if exact:
        sets = sets_of(classes.select(F.col("c").alias("doc_id")))
        lists = _prefixes(classes.select("c", "n"), sets, scratch, num, den)
    else:
        lists = _index(classes, scratch, num, den)
        sets = sets_of(lists.select(F.col("c").alias("doc_id")).distinct())
    met, links = met_pivots(lists, "first")
    # what a pivot met is settled, so it leaves its lists
    rest = _marked(met.where("c <> a").select("v", "c", "n"), _labels(links), scratch)
    found = not rest.isEmpty()
    if found and not exact:
        again = _prefixes(rest.select("c", "n").distinct(), sets, scratch, num, den)
        again = _marked(again, _labels(links), scratch).select("v", "c", "n")
        met, more = met_pivots(again, "second")
        links = links.unionByName(more)
        rest = _marked(met.where("c <> a").select("v", "c", "n"), _labels(links), scratch)
        found = not rest.isEmpty()
    if found:
        clusters = components(scratch, rest.select(F.col("c").alias("a"), F.col("least").alias("b")))
        members = rest.groupBy("c", "label").agg(F.max("n").alias("n")).join(clusters.select(F.col("node").alias("c"), F.col("component").alias("cluster")), "c")
        dealt = _blocks(scratch.save(members, "members"), scratch).join(sets.select(F.col("doc_id").alias("c"), "shingles"), "c")
        links = links.unionByName(scratch.save(dealt.groupBy("cluster", "i", "j").applyInArrow(released_group(_met(num, den)), "a long, b long"), "more", "a"))
    labels = components(scratch, links)
    keys = classes.select(F.col("n").alias("n_shingles"), "f1", "f2", "c")
    keys = keys.join(labels.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("c", F.coalesce("component", "c")).drop("component")
    keys = scratch.save(keys, "keys")
    scratch.drop(sets, lists, classes)
    out = base.drop("sketch").join(keys, ["n_shingles", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
