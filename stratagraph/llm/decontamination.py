"""Benchmark decontamination by a prefix-filtered containment join.

Every benchmark item is cut into windows of ``window`` words (a shorter item is one
window). For exact containment of a window one token is a sufficient prefix: its
rarest word, by counts over all documents. Document words are joined with these
rare words only; the word's place in the window gives the one start at which the
window could stand (position filter), which must leave room within the document (length
filter), and the words there are verified against the whole window.

Words are counted in one scan, by ``SLOTS`` hash slots, so the counts have a fixed
size; which word of a window counts as rarest decides about work, never about
results. Windows and their items are written tables. An index of up to
``INDEX_BYTES`` of them is broadcast, and documents are not shuffled. Beyond that only
two bitmaps of fixed size are: one of rare words, one of windows. Places that pass
both are joined with the table of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .memory import released
from .scratch import Scratch, as_rows, text_of

#: Slots by which words are counted.
SLOTS = 1 << 20
#: Bytes of the largest index that is broadcast.
INDEX_BYTES = 32 << 20
#: Bits of each bitmap, as a power of two.
BITS = 27

_WINDOWS = "value long, size int, token long, shift int, item string"


@dataclass(frozen=True)
class Index:
    """Windows by their rarest word."""

    token: np.ndarray  # sorted rare words
    first: np.ndarray  # token -> its first entry; one more at the end
    shift: np.ndarray  # entry -> the rare word's place in the window
    size: np.ndarray  # entry -> words in the window
    value: np.ndarray  # entry -> hash of the window
    owner: np.ndarray  # entry -> its first item in ``items``; one more at the end
    items: np.ndarray  # places of items in ``names``
    names: list[str]


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = wordhash.buffers(text)
    h, _, _, first = wordhash.words(data, offsets, wordhash.alphanumeric_words())
    return h, first


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their words, each row's first word) of parts of a batch with texts."""
    _, offsets = wordhash.buffers(text_of(batch))
    for a, b in wordhash.slices(offsets):
        part = batch.slice(a, b - a)
        yield part, *_words(text_of(part))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)


def _counted(wanted: np.ndarray | None):
    """How often the words of each slot stand in a partition; only of ``wanted`` slots, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, h, _ in _parts(batch):
                total += np.bincount(_slot(h), minlength=SLOTS)
        on = np.flatnonzero(total) if wanted is None else wanted[total[wanted] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(total[on])], names=["slot", "n"])

    return run


def slot_counts(docs: DataFrame, texts: DataFrame) -> np.ndarray:
    """Occurrences in docs of the words of each slot that a word of ``texts`` falls into; ``SLOTS`` numbers."""
    counts = lambda frame, wanted: frame.select(F.col("text").cast("string").alias("text")).mapInArrow(released(_counted(wanted)), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    wanted = np.sort(np.asarray(counts(texts, None)["slot"]))
    out = np.zeros(SLOTS, np.int64)
    if len(wanted):
        found = counts(docs, wanted)
        out[np.asarray(found["slot"])] = np.asarray(found["n"])
    return out


def _cut(counts: np.ndarray, window: int):
    """The windows of each item, with their rarest words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, first in _parts(batch):
                rarity, words = counts[_slot(h)], np.diff(first)
                for size in np.unique(np.minimum(words, window)).tolist():
                    if not size:
                        continue
                    start = wordhash.inside_rows(first, size)
                    row = np.searchsorted(first, start, "right") - 1
                    own = np.minimum(words, window)[row] == size
                    start, row = start[own], row[own]
                    best = start
                    for j in range(1, size):
                        at = start + j
                        less = (rarity[at] < rarity[best]) | ((rarity[at] == rarity[best]) & (h[at] < h[best]))
                        best = np.where(less, at, best)
                    value = wordhash.gram_at(h, start, size)
                    columns = [value.view(np.int64), np.full(len(start), size, np.int32), h[best].view(np.int64), (best - start).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), part.column("item").take(pa.array(row))], names=["value", "size", "token", "shift", "item"])

    return run


def index_of(windows: pa.Table, owners: pa.Table) -> Index:
    """An index of distinct windows and of their distinct owners."""
    token = np.asarray(windows["token"]).view(np.uint64)
    order = np.argsort(token, kind="stable")
    token = token[order]
    unique, at = np.unique(token, return_index=True)
    value, size, shift = (np.asarray(windows[c])[order] for c in ("value", "size", "shift"))
    names, item = np.unique(np.array(owners["item"].to_pylist(), object), return_inverse=True) if len(owners) else (np.empty(0, object), np.empty(0, np.int64))
    # both sides in order of (value, size)
    entry = np.lexsort((size, value))
    own = np.lexsort((item, np.asarray(owners["size"]), np.asarray(owners["value"])))
    by = lambda table: np.stack([np.asarray(table["value"], np.int64), np.asarray(table["size"], np.int64)], 1)
    keys = by(owners)[own]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.empty(0, bool)
    firsts = np.append(np.flatnonzero(fresh), len(keys))
    begin, count = np.empty(len(entry), np.int64), np.empty(len(entry), np.int64)
    begin[entry], count[entry] = firsts[:-1], np.diff(firsts)
    _, places = _expand(begin, begin + count)
    return Index(unique, np.append(at, len(token)).astype(np.int64), shift.astype(np.int64), size.astype(np.int64), value.view(np.uint64), np.concatenate([[0], np.cumsum(count)]).astype(np.int64), item[own][places].astype(np.int64), names.tolist())


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) of all integers in [first, last) ranges."""
    counts = last - first
    which = np.repeat(np.arange(len(first)), counts)
    return which, np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + first[which]


def occurrences(index: Index, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, entry) of every window that stands in a row."""
    if not len(index.token) or not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    near = np.minimum(np.searchsorted(index.token, h), len(index.token) - 1)
    place = np.flatnonzero(index.token[near] == h)
    which, entry = _expand(index.first[near[place]], index.first[near[place] + 1])
    place = place[which]
    row = np.searchsorted(first, place, "right") - 1
    start = place - index.shift[entry]
    fits = (start >= first[row]) & (start + index.size[entry] <= first[row + 1])
    start, entry = start[fits], entry[fits]
    good = np.zeros(len(start), bool)
    for size in np.unique(index.size[entry]).tolist():
        on = np.flatnonzero(index.size[entry] == size)
        good[on] = wordhash.gram_at(h, start[on], size) == index.value[entry[on]]
    return start[good], entry[good]


def _lists(values: pa.Array, row: np.ndarray, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def _matched(index: Index):
    """Adds n_words, the spans (start, end by words, flattened) and the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(index.names, pa.string())
        for batch in batches:
            for part, h, first in _parts(batch):
                start, entry = occurrences(index, h, first)
                order = np.argsort(start, kind="stable")
                start, entry = start[order], entry[order]
                row = np.searchsorted(first, start, "right") - 1
                low = (start - first[row]).astype(np.int32)
                spans = np.stack([low, low + index.size[entry].astype(np.int32)], 1).ravel()
                which, at = _expand(index.owner[entry], index.owner[entry + 1])
                pair = np.unique(row[which] * len(names) + index.items[at]) if len(at) else np.empty(0, np.int64)
                items = names.take(pa.array(pair % max(1, len(names))))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(first)), _lists(pa.array(spans), np.repeat(row, 2), n), _lists(items, pair // max(1, len(names)), n)],
                    names=[*part.schema.names, "n_words", "spans", "items"],
                )

    return run


def _bitmap(values: DataFrame) -> np.ndarray:
    """2 ** ``BITS`` bits, of which those are set that the leading bits of the values name."""
    place = F.shiftrightunsigned("x", 64 - BITS)
    rows = values.select((F.shiftright(place, 6)).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(x, {64 - BITS}) & 63 as int))").alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, np.uint64)
    out[np.asarray(found["word"])] = np.asarray(found["bits"]).view(np.uint64)
    return out


def _set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - BITS)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _candidates(tokens: np.ndarray, values: np.ndarray, shapes: list[tuple[int, int]]):
    """Places where a window may stand: a rare word stands at a window's ``shift``, and the window's hash is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, first in _parts(batch):
                place = np.flatnonzero(_set(tokens, h))
                row = np.searchsorted(first, place, "right") - 1
                for size, shift in shapes:
                    start = place - shift
                    fits = (start >= first[row]) & (start + size <= first[row + 1])
                    start, at = start[fits], row[fits]
                    value = wordhash.gram_at(h, start, size)
                    on = _set(values, value)
                    start, at, value = start[on], at[on], value[on]
                    keys = [part.column(c).take(pa.array(at)) for c in ("k1", "k2")]
                    columns = [value.view(np.int64), np.full(len(at), size, np.int32), (start - first[at]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, columns)], names=["k1", "k2", "value", "size", "start"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, first in _parts(batch):
            kept = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(np.diff(first))], names=[*kept, "n_words"])


def _joined(rows: DataFrame, windows: DataFrame, owners: DataFrame, scratch: Scratch) -> DataFrame:
    """What ``_matched`` gives, for any number of windows. Equal texts are judged once, by two hashes of the text."""
    text = F.col("text" if "text" in rows.columns else "row.text")
    rows = rows.withColumns({"k1": F.xxhash64(F.lit(1), text), "k2": F.xxhash64(F.lit(2), text)})
    shapes = sorted((r["size"], r["shift"]) for r in windows.select("size", "shift").distinct().collect())
    found = rows.select("k1", "k2", text.alias("text")).mapInArrow(released(_candidates(_bitmap(windows.select(F.col("token").alias("x"))), _bitmap(windows.select(F.col("value").alias("x"))), shapes)), "k1 long, k2 long, value long, size int, start int")
    hits = scratch.save(found.distinct().join(windows.select("value", "size"), ["value", "size"], "left_semi"), "hits")
    key = ["k1", "k2"]
    spans = hits.groupBy(*key).agg(F.flatten(F.array_sort(F.collect_list(F.array("start", F.col("start") + F.col("size"))))).alias("spans"))
    items = hits.select(*key, "value", "size").distinct().join(owners, ["value", "size"]).select(*key, "item").distinct().groupBy(*key).agg(F.collect_list("item").alias("items"))
    # written, so that the join may split the partition of a text that very many rows have
    judged = scratch.save(spans.join(items, key), "judged")
    whole = rows.mapInArrow(released(_numbered), T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("n_words", T.LongType())]))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return whole.join(judged, key, "left").select("row", "n_words", F.coalesce("spans", none("int")).alias("spans"), F.coalesce("items", none("string")).alias("items"))


def _covered(spans: F.Column) -> F.Column:
    """How many words flattened (start, end) spans cover; starts ascend within each index's share."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(2)), lambda i: F.struct(F.element_at(spans, i).alias("a"), F.element_at(spans, i + 1).alias("b"))))
    step = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda s, p: F.struct((s.n + F.greatest(p.b - F.greatest(p.a, s.to), F.lit(0))).alias("n"), F.greatest(p.b, s.to).alias("to")))
    return F.when(F.size(spans) == 0, F.lit(0)).otherwise(step.n)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs (doc_id long, text string, ...), benchmark (item_id, text string, ...) -> (row, n_words, n_hit, spans, items), a row for each row of docs.

    row: a struct of the columns of docs. Words are lower-cased (A-Z) runs of
    letters, digits and bytes over 127. A window is ``window`` consecutive words of an item, or all
    words of a shorter one; a document word inside any occurrence is hit. spans:
    start and end, in words, of the occurrences, flattened; items: item_ids with
    occurring windows, as sorted strings. Null and empty texts have no words and hold
    nothing; items without words or without an id are not looked for; items
    that share an id are one. Rows that repeat a doc_id, or have none, are judged as they are.
    An empty table gives an empty one, an empty benchmark hits nothing.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    rows = as_rows(docs)
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null")
    cut = scratch.save(texts.mapInArrow(released(_cut(slot_counts(docs, texts), window)), _WINDOWS), "cut")
    windows = scratch.save(cut.groupBy("value", "size").agg(F.min(F.struct("token", "shift")).alias("t")).select("value", "size", "t.token", "t.shift"), "windows")
    owners = scratch.save(cut.select("value", "size", "item").distinct(), "owners")
    scratch.drop(cut)
    size = 24 * windows.count() + (owners.agg(F.sum(F.octet_length("item") + 64)).first()[0] or 0)
    if size <= INDEX_BYTES:
        schema = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
        found = rows.mapInArrow(released(_matched(index_of(windows.toArrow(), owners.toArrow()))), schema)
        scratch.close()
    else:
        found = _joined(rows, windows, owners, scratch)
    return found.select("row", "n_words", _covered(F.col("spans")).cast("long").alias("n_hit"), "spans", F.array_sort(F.array_distinct("items")).alias("items"))
