"""Vectorised word splitting and hashing over Arrow string columns.

Everything here works on whole Arrow buffers: no text becomes a Python string.
Bytes are handled in segments of ``SEGMENT`` bytes cut between words, so the
scratch memory of one call does not grow with the length of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19
SLICE = 2 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_GRAM = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_powers = np.ones(1, dtype=np.uint64)


def white_space_words(lower: bool) -> np.ndarray:
    """Byte table for words ``[^\\x20\\x09-\\x0D]+``: 0 for a separator, else the byte plus one."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return _folded(table) if lower else table


def alphanumeric_words() -> np.ndarray:
    """Byte table for lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    table = _folded(np.arange(1, 257, dtype=np.uint16))
    keep = np.zeros(256, dtype=bool)
    keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
    table[~keep] = 0
    return table


def _folded(table: np.ndarray) -> np.ndarray:
    table[0x41:0x5B] = table[0x61:0x7B]
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    """At least the first n powers of the base."""
    global _powers
    if len(_powers) < n:
        size = 1 << max(10, (n - 1).bit_length())
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after, row's first word) of all words of all rows.

    The last array has one more entry than there are rows.
    """
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    hashes, starts, ends = [], [], []
    at = 0
    while at < n:
        to = min(n, at + SEGMENT)
        step = SEGMENT
        while to < n:  # cut between words
            tail = table[data[max(at, to - 4096) : to]] == 0
            tail |= edge[max(at, to - 4096) + 1 : to + 1]
            found = np.flatnonzero(tail)
            if len(found):
                to = max(at, to - 4096) + int(found[-1]) + 1
                break
            step *= 2
            to = min(n, at + step)
        value = table[data[at:to]]
        inside = value > 0
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1] | edge[at + 1 : to]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[at + 1 : to]
        first = np.flatnonzero(fresh)
        if len(first):
            lead = int(first[0])
            reach = np.diff(first, append=to - at)
            place = np.arange(lead, to - at) - np.repeat(first, reach)
            term = value[lead:].astype(np.uint64) * powers(int(reach.max()) + 1)[place]
            hashes.append(np.add.reduceat(term, first - lead))
            starts.append(first + at)
            ends.append(np.flatnonzero(last) + 1 + at)
        at = to
    if not hashes:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    start, end = np.concatenate(starts), np.concatenate(ends)
    h = mix(np.concatenate(hashes) + (end - start).astype(np.uint64) * _MULT)
    return h, start, end, np.searchsorted(start, offsets, "left")


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values, whatever rows they lie in."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    out, done, block, width = None, 0, h, 1
    left = size
    while left:
        if left & 1:
            part = block[done : done + len(h) - size + 1] * np.uint64(pow(_GRAM, done, 1 << 64))
            out = part if out is None else out + part
            done += width
        left >>= 1
        if left:
            block = block[:-width] + block[width:] * np.uint64(pow(_GRAM, width, 1 << 64))
            width *= 2
    return mix(out + np.uint64(size * _BASE & _MASK))


def gram_at(h: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """What ``grams`` has at some starts only."""
    out = np.zeros(len(start), np.uint64)
    for i in range(size):
        out += h[start + i] * np.uint64(pow(_GRAM, i, 1 << 64))
    return mix(out + np.uint64(size * _BASE & _MASK))


def inside_rows(first_word: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of ``size`` words that lie in one row each."""
    counts = np.maximum(np.diff(first_word) - size + 1, 0)
    total = int(counts.sum())
    shift = np.repeat(first_word[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total, dtype=np.int64) + shift
