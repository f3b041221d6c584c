"""Memory of Python workers: they live on beside others, so what a task needed goes back to the system when it ends."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of a group from which on it is worth it.
LARGE = 4 << 20


def trim() -> None:
    """Give free memory back; where the C library cannot, only Arrow's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function of batches that gives memory back after its last one."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def released_group(run: Callable) -> Callable:
    """A function of a key and a table, or of two tables, that gives memory back after a large one."""

    def wrapped(a, b):
        size = sum(x.nbytes for x in (a, b) if isinstance(x, pa.Table))
        try:
            return run(a, b)
        finally:
            if size >= LARGE:
                trim()

    return wrapped
