"""Token-id matrices by best-fit-decreasing packing.

Documents longer than a window are split losslessly into windows; what remains
goes, longest first, into the fullest open window that still has room. A segment
tree over the free room of windows finds it: a leaf counts windows with just that
much room, and the search for the least sufficient leaf takes log2(capacity) steps, however
many windows are open.

Pieces are dealt into groups of about ``packing.GROUP_BYTES`` of input as ``packing`` does;
a group is packed in one task and makes its rows of the matrix. ``write_matrices``
stores them as plain binary files, written by the tasks.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import released_group
from .packing import dealt


class RoomTree:
    """Counts of open windows by free room, with search for the least room that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, change: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += change
            at >>= 1

    def enough(self, room: int) -> int | None:
        """The least room >= ``room`` of any open window."""
        at = self.size + room
        if self.count[at]:
            return room
        while at > 1:
            if not at & 1 and self.count[at + 1]:  # the nearest subtree to the right
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(window, offset in it) of each piece, in the order given; longest first inside."""
    tree, by_room = RoomTree(capacity), [[] for _ in range(capacity + 1)]
    window, offset, made = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room = tree.enough(n)
        if room is None:
            at, room, made = made, capacity, made + 1
        else:
            at = by_room[room].pop()
            tree.add(room, -1)
        window[i], offset[i] = at, capacity - room
        if room > n:
            by_room[room - n].append(at)
            tree.add(room - n, 1)
    return window, offset


def _matrix(capacity: int, pad_id: int, stored: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(table["start"]), np.asarray(table["doc_id"].fill_null(-(1 << 63)))))
        table = table.take(pa.array(order))
        lengths = np.asarray(table["length"])
        window, offset = (np.array(x, np.int64) for x in best_fit(lengths.tolist(), capacity))
        order = np.lexsort((offset, window))
        window, offset, lengths = window[order], offset[order], lengths[order]
        bins = int(window[-1]) + 1 if len(window) else 0
        ids = np.full((bins, capacity), pad_id, stored)
        own = table["ids"]
        for i, w, o, n in zip(order.tolist(), window.tolist(), offset.tolist(), lengths.tolist()):
            ids[w, o : o + n] = np.frombuffer(own[i].as_buffer(), stored)
        first = np.searchsorted(window, np.arange(bins + 1))
        used = np.add.reduceat(lengths, first[:-1]) if bins else np.empty(0, np.int64)
        # each window's cumulative lengths: its offsets, then its end
        ends = np.insert(offset, first[1:], used)
        column = np.arange(capacity)
        starts = np.zeros((bins, capacity), np.int32)
        starts[window, offset] = offset
        full = np.flatnonzero(used < capacity)
        starts[full, used[full]] = used[full]  # padding counts from 0 again
        positions = (column - np.maximum.accumulate(starts, axis=1)).astype("<u2" if capacity <= 65536 else "<u4")
        lists = lambda values, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
        blob = lambda rows: pa.array([x.tobytes() for x in rows], pa.binary())
        taken = table.take(pa.array(order))
        return pa.table(
            [
                pa.array((key[0].as_py() << 32) + np.arange(bins)),
                lists(taken["doc_id"].combine_chunks(), first),
                lists(taken["start"].combine_chunks(), first),
                lists(pa.array(ends.astype(np.int32)), first + np.arange(bins + 1)),
                pa.array(used, pa.int32()),
                blob(ids),
                blob(positions),
            ],
            names=["sequence_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", "ids", "position_ids"],
        )

    return run


def token_matrices(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 50256, pad_id: int = 50256, stored: str = "<u2") -> DataFrame:
    """docs (doc_id long, text string, ...) -> a row for each packed window.

    sequence_id; doc_ids and starts of its pieces in order (start: the document's
    ids before the piece); cu_seqlens: 0 and the cumulative lengths; n_tokens without
    padding; ids: ``capacity`` ids in the numpy type ``stored``, padded with ``pad_id``;
    position_ids: as many 16-bit positions (32-bit over 65536) that start at 0 with
    each piece and with the padding. A document is its ids, without added special
    tokens, then ``end_id``; null and empty texts are that id alone. Ids beyond the range of ``stored`` raise. Rows that
    repeat a doc_id, or have none, are documents of their own. An empty table
    gives an empty one; other columns are ignored.
    """
    rows = dealt(docs, tokenizer, capacity, end_id, stored, pad_id)
    ddl = "sequence_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, n_tokens int, ids binary, position_ids binary"
    return rows.groupBy("pack_group").applyInArrow(released_group(_matrix(capacity, pad_id, stored)), ddl)


_FILES = "part long, windows long, n_tokens long, ids_crc32 long, cu_seqlens_crc32 long"


def _put(files: fs.FileSystem, path: str, data: bytes) -> None:
    """Whole or not at all: a task that is run again, or twice at once, ends with the same file."""
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, path)


def _written(folder: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        files, root = fs.FileSystem.from_uri(folder)
        part = key[0].as_py()
        table = table.sort_by("sequence_id")
        ids, positions = (b"".join(table[c].to_pylist()) for c in ("ids", "position_ids"))
        ends = table["cu_seqlens"].combine_chunks()
        flat = np.asarray(ends.flatten(), "<i4")
        # each window's number of entries, then all entries
        lengths = np.concatenate([[len(table)], np.diff(np.asarray(ends.offsets)), flat]).astype("<i4").tobytes()
        for kind, data in (("ids", ids), ("positions", positions), ("cu_seqlens", lengths)):
            _put(files, f"{root}/part-{part:06d}.{kind}.bin", data)
        row = [part, len(table), int(np.asarray(table["n_tokens"], np.int64).sum()), zlib.crc32(ids), zlib.crc32(lengths)]
        return pa.table([pa.array([x], pa.int64()) for x in row], names=[f.split()[0] for f in _FILES.split(", ")])

    return run


def write_matrices(matrices: DataFrame, folder: str, capacity: int = 2048, stored: str = "<u2") -> DataFrame:
    """What ``token_matrices`` gives, as plain binary files -> (part, windows, n_tokens, ids_crc32, cu_seqlens_crc32), a row for each part.

    ``folder``: a URI that pyarrow's file systems know and all executors reach. A
    part is one group of windows: ``part-N.ids.bin`` and ``part-N.positions.bin`` hold a row
    of ``capacity`` numbers for each window, in order of sequence_id; ``part-N.cu_seqlens.bin``
    holds 32-bit numbers: the windows, each one's number of entries, and all entries.
    ``layout.json`` names the types. Tasks write the files, each whole before it gets its
    name, so tasks that are run again leave the same files. An empty table gives no parts.
    """
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    rows = matrices.withColumn("part", F.shiftright("sequence_id", 32)).groupBy("part").applyInArrow(released_group(_written(folder)), _FILES)
    spark = matrices.sparkSession
    rows.write.mode("overwrite").parquet(f"{folder}/parts")
    layout = {"capacity": capacity, "ids": stored, "positions": "<u2" if capacity <= 65536 else "<u4", "cu_seqlens": "<i4"}
    _put(files, f"{root}/layout.json", json.dumps(layout).encode())
    return spark.read.schema(_FILES).parquet(f"{folder}/parts")


def read_part(folder: str, part: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids, positions, cumulative lengths of each window) of one part."""
    files, root = fs.FileSystem.from_uri(folder)

    def raw(name: str) -> bytes:
        with files.open_input_stream(f"{root}/{name}") as file:
            return file.read()

    layout = json.loads(raw("layout.json"))
    ids, positions, lengths = (np.frombuffer(raw(f"part-{part:06d}.{k}.bin"), layout[k]) for k in ("ids", "positions", "cu_seqlens"))
    n = int(lengths[0]) if len(lengths) else 0
    return ids.reshape(-1, layout["capacity"]), positions.reshape(-1, layout["capacity"]), np.split(lengths[1 + n :], np.cumsum(lengths[1 : 1 + n])[:-1])
