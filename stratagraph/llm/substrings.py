"""Substring dedup by difference-cover anchors.

The residues ``COVER`` modulo ``PERIOD`` hold every difference, so for two equal
runs at any two positions some shift below ``PERIOD`` brings both to covered
positions. Hashing windows of ``length - PERIOD + 1`` words at covered positions
only (4 of 13) therefore gives every pair of equal runs of ``length`` words an
anchor in common.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, wordhash

PERIOD, COVER = 13, (0, 1, 3, 9)


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, first = wordhash.words(data, offsets, wordhash.white_space_words(lower=False))
    return h, first


def _cover_anchors(size: int):
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True

    def run(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = wordhash.inside_rows(first, size)
        row = np.searchsorted(first, at, "right") - 1
        at = at[covered[(at - first[row]) % PERIOD]]
        return at, wordhash.grams(h, size)[at]

    return run


def dedup_substrings(docs: DataFrame, length: int = 20) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, n_words, n_removed, kept_text), a row for each row of docs.

    Words are runs of bytes other than ASCII white space, unchanged. Every word
    that a window of ``length`` words covers whose word sequence also starts
    earlier (smaller doc_id, or earlier in the document) is removed; windows are
    judged on the input. kept_text: the other words, joined by one space. Null,
    empty and blank texts have no words. Rows that repeat a doc_id count as one
    document: they are no repeats of each other at the same position; where
    their texts differ, each loses its own repeats only. A null doc_id counts as the least. An empty table gives
    an empty one; other columns are ignored.
    """
    if length <= PERIOD:
        raise ValueError(f"length must be over {PERIOD}")
    plan = repeats.Plan(word_units, _cover_anchors(length - PERIOD + 1), length - PERIOD + 1, length)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def finish(table: pa.Table, marked: np.ndarray, first: np.ndarray) -> pa.Table:
        texts, kept, dropped = table["text"], [], []
        left = ~marked
        for i in range(len(table)):
            own = (texts[i].as_py() or "").encode().split()
            keep = left[first[i] : first[i + 1]]
            dropped.append(int(len(keep) - keep.sum()))
            kept.append(b" ".join(compress(own, keep.tolist()) if dropped[-1] else own))
        return pa.table([table["doc_id"], pa.array(np.diff(first), pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return repeats.mark(plan, docs, finish, "doc_id long, n_words long, n_removed long, kept_text string")
