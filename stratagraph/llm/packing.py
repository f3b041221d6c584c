"""Packing by minimum bin slack.

Documents are cut into windows of ``capacity`` ids; what remains of each is
packed. For one window the longest remainder left is fixed, and a bitset of
reachable sums (bit s: some multiset of the other lengths adds up to s) grows length
by length, each with its count split into powers of two, until the free room
is reached exactly or all lengths are in. The best sum is traced back to counts
of lengths, and that multiset fills as many windows as the counts allow.

Pieces are dealt into groups of about ``GROUP_BYTES`` of input by a hash of
doc_id, start, content and the row's place in its table, so neither equal texts or lengths nor rows
that share an id gather in one task, and a group fits in memory; each group leaves a few windows short at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens, wordhash
from .memory import released, released_group
from .scratch import pieces_for

GROUP_BYTES = 16 << 20
#: Bytes of text that a worker encodes at a time.
STEP = 1 << 20

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PIECE_DDL = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"


def pieces(path: str, capacity: int, end_id: int, stored: str | None, words: int = tokens.CACHE_WORDS):
    """mapInArrow function: documents -> pieces of at most ``capacity`` ids, each document's ids followed by ``end_id``; ids in the numpy type ``stored``, or left out."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, words).encode
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            _, offsets = wordhash.buffers(text)
            for a, b in wordhash.slices(offsets, STEP):
                row, start, length, crc, total, own = [], [], [], [], [], []
                for i, raw in enumerate(encode([x or "" for x in text.slice(a, b - a).to_pylist()])):
                    raw += end
                    for at in range(0, len(raw), 4 * capacity):
                        part = raw[at : at + 4 * capacity]
                        row.append(i)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(len(raw) // 4)
                        own.append(None if stored is None else part if stored == "<u4" else np.frombuffer(part, "<u4").astype(stored).tobytes())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(own, pa.binary())], schema=_PIECES)

    return run


def least_slack(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(lengths of one window with their multiplicities, number of such windows) until all are packed."""
    left = dict(sorted(((n, c) for n, c in counts.items() if c), reverse=True))
    while left:
        longest = next(iter(left))
        room = capacity - longest
        reach, steps = 1, []
        for n, c in left.items():
            c = min(c - (n == longest), room // n)
            k = 1
            while c > 0 and not reach >> room & 1:
                k = min(k, c)
                steps.append((n, k, reach))
                reach |= (reach << n * k) & ((1 << room + 1) - 1)
                c -= k
                k *= 2
            if reach >> room & 1:
                break
        best = reach.bit_length() - 1
        chosen = {longest: 1}
        for n, k, before in reversed(steps):
            if not before >> best & 1:
                chosen[n] = chosen.get(n, 0) + k
                best -= n * k
        times = min(left[n] // k for n, k in chosen.items())
        yield chosen, times
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence from 0, offset in it) of each piece."""
    sequence, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    sizes, first, count = np.unique(lengths[order], return_index=True, return_counts=True)
    at = dict(zip(sizes.tolist(), first.tolist()))
    made = 0
    for chosen, times in least_slack(dict(zip(sizes.tolist(), count.tolist())), capacity):
        lead = 0
        for n, k in chosen.items():
            own = order[at[n] : at[n] + k * times]
            at[n] += k * times
            j = np.arange(k * times)
            sequence[own], offset[own] = made + j // k, lead + j % k * n
            lead += k * n
        made += times
    return sequence, offset


def _packed(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = pa.array(np.lexsort((np.asarray(table["ids_crc32"]), np.asarray(table["start"]), np.asarray(table["doc_id"].fill_null(-(1 << 63))))))
        table = table.take(order)
        sequence, offset = place(np.asarray(table["length"]), capacity)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        return pa.table([*(table[c] for c in names), pa.array(sequence + (key[0].as_py() << 32)), pa.array(offset, pa.int32())], names=[*names, "sequence_id", "offset"])

    return run


def dealt(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, stored: str | None, *others: int, words: int = tokens.CACHE_WORDS) -> DataFrame:
    """The pieces of docs with their ``pack_group``. Raises if an id does not fit ``stored``."""
    groups = pieces_for(docs, GROUP_BYTES, 1)
    most = max(tokens.largest_id(tokenizer), end_id, *others)
    if stored is not None and most > np.iinfo(stored).max:
        raise ValueError(f"id {most} does not fit {stored}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(released(pieces(tokenizer, capacity, end_id, stored, words)), _PIECE_DDL)
    lot = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    return rows.withColumn("pack_group", F.pmod(lot, F.lit(groups)).cast("int"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, stored: str | None = "<u4", words: int = tokens.CACHE_WORDS) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset), a row for each piece.

    ``tokenizer``: path of a tokenizers .json file. A document is its ids, without
    added special tokens, then ``end_id``; null and empty texts are that id alone. It
    is cut at multiples of ``capacity``, so no id is lost or doubled. Pieces of one
    sequence_id lie in it one after another from offset 0 and hold at most ``capacity`` ids;
    the rest of the sequence is padding. ids: bytes of the numpy type
    ``stored``, or null without one, and ids over its range raise; ids_crc32 is of little-endian unsigned 32-bit ids in any case. Rows that repeat a doc_id, or have none, are
    documents of their own. An empty table gives an empty one; other columns are ignored. ``words``: how many a worker
    keeps the ids of; fewer take less memory and more time.
    """
    rows = dealt(docs, tokenizer, capacity, end_id, stored, words=words)
    ddl = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset int"
    return rows.groupBy("pack_group").applyInArrow(released_group(_packed(capacity)), ddl)
