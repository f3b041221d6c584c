"""Line dedup by winnowing over line hashes.

Hashes of ``gram`` consecutive lines are taken, and the least of every
``window`` neighbouring ones (the last on a tie) is a fingerprint. Equal runs of
``gram + window - 1`` lines hold one window in common, so they share a fingerprint
wherever they stand. Positions of shared fingerprints are joined and extended
both ways; later repeats of a run are deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats, wordhash
from .scratch import column

_BLANK = " \t\n\r\x0b\x0c"


def line_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines that are not blank; white space counts as word breaks only."""
    h, start, _, first = wordhash.words(data, offsets, wordhash.white_space_words(lower=False))
    if not len(h):
        return h, np.zeros(len(offsets), np.int64)
    line = np.searchsorted(np.flatnonzero(data == 10), start)
    fresh = np.concatenate([[True], line[1:] != line[:-1]])
    fresh[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(fresh)
    reach = np.diff(at, append=len(h))
    place = np.arange(len(h)) - np.repeat(at, reach)
    sums = np.add.reduceat(h * wordhash.powers(int(reach.max()))[place], at)
    return wordhash.mix(sums + reach.astype(np.uint64)), np.searchsorted(at, first, "left")


def _winnowed(gram: int, window: int):
    def run(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = wordhash.grams(h, gram)
        start = wordhash.inside_rows(first, gram + window - 1)
        best = start
        for j in range(1, window):
            best = np.where(g[start + j] <= g[best], start + j, best)
        best = np.unique(best)
        return best, g[best]

    return run


def dedup_lines(docs: DataFrame, gram: int = 2, window: int = 2) -> DataFrame:
    """What ``deduped`` gives, with the columns of docs beside ``report``; for docs without a column of that name."""
    return deduped(docs, gram, window).select("report", "row.*")


def deduped(docs: DataFrame, gram: int = 2, window: int = 2) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (row, report): its columns with the text that stays, and n_lines, n_removed before.

    Lines end at a newline; blank ones count for nothing and stay. A run is
    ``gram + window - 1`` lines in a row that are equal but for the amount of
    white space between words. Every line that a run covers which also starts
    earlier (smaller doc_id, or earlier in the document) is deleted with its
    newline; runs are judged on the input. If no line but blank ones stays, the
    text is empty. A null text stays null. Rows that repeat a doc_id count as
    one document, as for substrings: equal rows keep the same lines; a null doc_id counts as the least. An
    empty table gives an empty one. Other columns pass through, whatever their names.
    """
    length = gram + window - 1
    plan = repeats.Plan(line_units, _winnowed(gram, window), gram, length)
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    rest = [F.struct(*(column(docs, f.name).alias(f"c{i}") for i, f in enumerate(others))).alias("rest")] if others else []
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)

    def finish(table: pa.Table, marked: np.ndarray, first: np.ndarray) -> pa.Table:
        texts, kept, dropped = table["text"], [], []
        for i in range(len(table)):
            own, keep = texts[i].as_py(), ~marked[first[i] : first[i + 1]]
            dropped.append(int(len(keep) - keep.sum()))
            if dropped[-1] == len(keep) and len(keep):
                own = ""
            elif dropped[-1]:
                left = iter(keep.tolist())
                own = "\n".join(x for x in own.split("\n") if not x.strip(_BLANK) or next(left))
            kept.append(own)
        out = {"doc_id": table["doc_id"], "text": pa.array(kept, pa.string()), "n_lines": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(dropped, pa.int64())}
        return pa.table(out | ({"rest": table["rest"]} if "rest" in table.column_names else {}))

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), *([packed.schema["rest"]] if others else [])])
    out = repeats.mark(plan, packed, finish, schema)
    at = {f.name: F.col(f"rest.c{i}") for i, f in enumerate(others)}
    return out.select(F.struct(*((at[c] if c in at else F.col(c)).alias(c) for c in docs.columns)).alias("row"), F.struct("n_lines", "n_removed").alias("report"))
