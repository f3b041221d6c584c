"""Runs of units (words, lines) that also start earlier in the corpus.

One exact plan serves two operators, which differ in units and anchors:

1. Anchors: hashes of short runs at chosen places, so chosen that two equal
   runs of ``length`` units always have an anchor in common. Each is dealt by
   its hash; an anchor that stands alone is dropped.
2. Extension: back at the document, anchors that occur elsewhere extend both
   ways to all windows of ``length`` units around them; only those windows
   are hashed (64 bits) and dealt. Of each window the first place, by
   (doc_id, position), stays; every other place is a repeat.
3. Back at the document again, units that repeats cover are marked.

Anchors, windows and marks travel as packed arrays, a row for each batch and
bucket, with what repeats within a batch resolved before it travels: a window
that a third of all documents share sends one entry a batch. Buckets follow the
size of the input, so no task grows with it. The documents cross the network
once: steps 2 and 3 read the same exchange.

A row is named by its ``row_key``, a hash of its doc_id and text, so rows that share
an id, or have none, lie in many buckets. Equal rows have one key and one result;
those that are more than a bucket holds are found beforehand, spread over several
buckets, and what is sent to them goes to each of these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .memory import released, released_group
from .scratch import pieces_for

#: Input bytes (as stored) for each bucket of hashes and of documents.
HASH_BYTES, DOC_BYTES = 4 << 20, 8 << 20
#: Rows of one doc_id from which on equal ones among them are counted.
SHARED_ROWS = 256
NO_ID = -(1 << 63)

_PACKED = pa.schema([("key", pa.int32()), ("docs", pa.binary()), ("rows", pa.binary()), ("counts", pa.binary()), ("pos", pa.binary()), ("hash", pa.binary())])
_DDL = "key int, docs binary, rows binary, counts binary, pos binary, hash binary"

#: data, offsets -> (unit hashes, row's first unit)
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: unit hashes, row's first unit -> (place of each anchor, its hash)
Anchors = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Plan:
    """Units and anchors of ``anchor`` units, such that equal runs of ``length`` units share one."""

    units: Units
    anchors: Anchors
    anchor: int
    length: int


@dataclass(frozen=True)
class Buckets:
    """Buckets of hashes and of documents; ``spread``: over how many the rows of a key lie, where it is more than one."""

    hashes: int
    documents: int
    spread: dict[int, int]

    def to_documents(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, key of its packed row) of items for rows; one for each bucket that the row may lie in."""
        first = rows % self.documents
        which, bucket = [np.arange(len(rows))], [first]
        for row, n in self.spread.items():
            at = np.flatnonzero(rows == row)
            which += [at] * (n - 1)
            bucket += [(first[at] + i) % self.documents for i in range(1, n)]
        return np.concatenate(which), (np.concatenate(bucket) + self.hashes).astype(np.int32)


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])


def _pack(key: np.ndarray, row: np.ndarray, pos: np.ndarray, hashes: np.ndarray | None = None, doc: np.ndarray | None = None, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of packed items, one for each key; of very many items, a row for each part."""
    for at in range(0, len(key), most):
        k, r, p = key[at : at + most], row[at : at + most], pos[at : at + most]
        order = np.argsort(k, kind="stable")
        k, r, p = k[order], r[order], p[order]
        turn = np.concatenate([[True], k[1:] != k[:-1]])
        run = turn | np.concatenate([[True], r[1:] != r[:-1]])
        first, runs = np.flatnonzero(turn), np.flatnonzero(run)
        ends = np.append(first, len(k))
        by_run = np.searchsorted(runs, ends)
        none = pa.array([b""] * len(first), pa.binary())
        h = none if hashes is None else _blobs(hashes[at : at + most][order], ends)
        d = none if doc is None else _blobs(doc[at : at + most][order][runs], by_run)
        yield pa.RecordBatch.from_arrays([pa.array(k[first], pa.int32()), d, _blobs(r[runs], by_run), _blobs(np.diff(runs, append=len(k)).astype(np.uint32), by_run), _blobs(p.astype(np.uint32), ends), h], schema=_PACKED)


def _flat(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    data, _ = wordhash.buffers(column)
    return data.view(kind) if len(data) else np.empty(0, kind)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row key, position, number of the run of its row) of packed items."""
    counts = _flat(table["counts"], np.uint32)
    run = np.repeat(np.arange(len(counts)), counts)
    return _flat(table["rows"], np.int64)[run], _flat(table["pos"], np.uint32).astype(np.int64), run


def row_units(text: pa.Array, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Unit hashes of all rows, and each row's first unit."""
    data, offsets = wordhash.buffers(text)
    found, firsts, so_far = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for a, b in wordhash.slices(offsets):
        h, first = units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found.append(h)
        firsts.append(first[1:] + so_far)
        so_far += len(h)
    return np.concatenate(found), np.concatenate(firsts)


def _again(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value stands more than once, and whether it is a later one of its kind."""
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    multiple, later = np.zeros(len(value), bool), np.zeros(len(value), bool)
    later[order[1:]] = same
    multiple[order[1:]] |= same
    multiple[order[:-1]] |= same
    return multiple, later


def _send(plan: Plan, buckets: Buckets):
    """Anchors of each batch; one that the batch has more than once is known to repeat and goes straight to its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("row_key"))
            data, offsets = wordhash.buffers(batch.column("text"))
            for a, b in wordhash.slices(offsets, 4 * wordhash.SLICE):
                h, first = plan.units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                place, value = plan.anchors(h, first)
                if not len(place):
                    continue
                at = np.searchsorted(first, place, "right") - 1
                row, pos = keys[a:b][at], place - first[at]
                multiple, later = _again(value)
                one, many = np.flatnonzero(~later), np.flatnonzero(multiple)
                yield from _pack((value[one] % np.uint64(buckets.hashes)).astype(np.int32), row[one], pos[one], (value[one] >> np.uint64(32)).astype(np.uint32))
                which, to = buckets.to_documents(row[many])
                yield from _pack(to, row[many][which], pos[many][which])

    return run


def _passed(table: pa.Table, hashes: int) -> pa.Table:
    """Packed rows that are for documents, under their bucket."""
    return table.set_column(0, "key", pa.array(np.asarray(table["key"]) - hashes, pa.int32()))


def _shared(buckets: Buckets):
    """Of a bucket's anchors, the places of those that occur more than once, for their documents.

    32 bits of the hash remain within a bucket: a chance hit only makes a window that step 2 compares in full.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets.hashes:
            return _passed(table, buckets.hashes)
        row, pos, _ = _unpack(table)
        hit, _ = _again(_flat(table["hash"], np.uint32))
        row, pos = row[hit], pos[hit]
        which, to = buckets.to_documents(row)
        return _passed(pa.Table.from_batches(list(_pack(to, row[which], pos[which])), schema=_PACKED), buckets.hashes)

    return run


def _spread(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in [start, end) of any span."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def _keyed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct row keys in order, a row of each, and for each row its key's place)."""
    return np.unique(np.asarray(table["row_key"]), return_index=True, return_inverse=True)


def _extend(plan: Plan, buckets: Buckets):
    """Hash the windows around anchors that repeat."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        keys, one, _ = _keyed(docs)
        row, pos, _ = _unpack(found)
        if not len(keys) or not len(row):
            return _PACKED.empty_table()
        docs = docs.select(["doc_id", "text"]).take(pa.array(one))
        h, first = row_units(docs["text"], plan.units)
        at = np.searchsorted(keys, row)
        last, place = first[at + 1] - plan.length, first[at] + pos
        lo, hi = np.maximum(place + plan.anchor - plan.length, first[at]), np.minimum(place, last) + 1
        fits = lo < hi
        start = np.flatnonzero(_spread(len(h), lo[fits], hi[fits]))
        if not len(start):
            return _PACKED.empty_table()
        value = wordhash.grams(h, plan.length)[start]
        at = np.searchsorted(first, start, "right") - 1
        doc, row, pos = np.asarray(docs["doc_id"].combine_chunks().fill_null(NO_ID))[at], keys[at], start - first[at]
        one, repeat = _first_places(doc, pos, value)
        out = list(_pack((value[one] % np.uint64(buckets.hashes)).astype(np.int32), row[one], pos[one], value[one], doc[one]))
        which, to = buckets.to_documents(row[repeat])
        out += list(_pack(to, row[repeat][which], pos[repeat][which]))
        return pa.Table.from_batches(out, schema=_PACKED)

    return run


def _first_places(doc: np.ndarray, pos: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items to compare further, those at the first (doc, pos) of their value; and items elsewhere."""
    order = np.lexsort((pos, doc, value))
    v, d, p = value[order], doc[order], pos[order]
    head = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.empty(0, bool)
    at = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (d != d[at]) | (p != p[at])
    return np.sort(order[~later]), np.sort(order[later])


def _resolve(buckets: Buckets):
    """Of a bucket's windows, all places but the first of each."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets.hashes:
            return _passed(table, buckets.hashes)
        row, pos, run = _unpack(table)
        _, repeat = _first_places(_flat(table["docs"], np.int64)[run], pos, _flat(table["hash"], np.uint64))
        row, pos = row[repeat], pos[repeat]
        which, to = buckets.to_documents(row)
        return _passed(pa.Table.from_batches(list(_pack(to, row[which], pos[which])), schema=_PACKED), buckets.hashes)

    return run


def _crowded(docs: DataFrame, documents: int) -> dict[int, int]:
    """Row keys of equal rows that are more than a bucket should hold, and over how many buckets to spread them.

    Reads only ids unless some have very many rows. Few keys can be so heavy: the limit grows with the number of buckets.
    """
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > SHARED_ROWS).select("doc_id")
    if shared.isEmpty():
        return {}
    limit = DOC_BYTES * max(1, documents >> 16)
    sized = docs.select("doc_id", "row_key", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("size")).alias("d")
    sized = sized.join(shared.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")
    heavy = sized.groupBy("row_key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where((F.col("size") > 2 * limit) & (F.col("n") > 1))
    return {r.row_key: int(min(r.n, documents, -(-r["size"] // limit))) for r in heavy.collect()}


def mark(plan: Plan, docs: DataFrame, finish: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """docs (doc_id long, text string, ...) -> what ``finish`` makes of a group of documents.

    finish(documents, marked, first): ``marked`` holds for each unit whether a run
    of ``plan.length`` units that covers it also starts earlier, ``first`` the
    first unit of each row. Rows that share a doc_id count as one document:
    equal runs at one position are no repeats of each other, and a mark holds for the rows that have its run there;
    a null doc_id counts as the least.
    """
    docs = docs.withColumn("row_key", F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)), "text"))
    documents = pieces_for(docs, DOC_BYTES)
    buckets = Buckets(pieces_for(docs, HASH_BYTES), documents, _crowded(docs, documents))
    bucket = F.pmod("row_key", F.lit(documents))
    if buckets.spread:
        over = docs.sparkSession.createDataFrame(list(buckets.spread.items()), "row_key long, over int")
        # few rows, see _crowded
        docs = docs.join(F.broadcast(over), "row_key", "left")
        bucket = F.pmod(bucket + F.pmod(F.monotonically_increasing_id(), F.coalesce("over", F.lit(1))), F.lit(documents))
    keyed = docs.withColumn("doc_bucket", bucket.cast("int")).drop("over")
    anchors = docs.select("row_key", "text").mapInArrow(released(_send(plan, buckets)), _DDL)
    found = anchors.groupBy("key").applyInArrow(released_group(_shared(buckets)), _DDL)
    windows = keyed.groupBy("doc_bucket").cogroup(found.groupBy("key")).applyInArrow(released_group(_extend(plan, buckets)), _DDL)
    repeats = windows.groupBy("key").applyInArrow(released_group(_resolve(buckets)), _DDL)
    length, units = plan.length, plan.units

    def close(table: pa.Table, marks: pa.Table) -> pa.Table:
        keys, one, place = _keyed(table)
        h, first = row_units(table["text"].take(pa.array(one)), units)
        row, pos, _ = _unpack(marks)
        at = first[np.searchsorted(keys, row)] + pos
        marked = _spread(len(h), at, at + length)
        # what is found for a key holds for each of its rows
        size = np.diff(first)[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        return finish(table, marked[np.repeat(first[place] - ends[:-1], size) + np.arange(ends[-1])], ends)

    return keyed.groupBy("doc_bucket").cogroup(repeats.groupBy("key")).applyInArrow(released_group(close), schema)
