"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>) over the terms of
a text, so that an insult near a group's name can weigh more than both alone.
Terms are lower-cased words and beginnings of words, hashed into ``TERMS`` slots, each counted once a text;
the ``CHOSEN`` slots that tell most about the label on the training rows have weights: alone, or among the
texts that hold one of the ``BASES`` most telling slots, so that a group's name that is as common in
clean texts is known for what it means beside an insult.

The machine is fitted on the driver on ``TRAIN_ROWS`` labelled rows at most, chosen
by a hash of doc_id and text, so fitting costs the same at any size, also where rows share an id; scoring reads
every whole text once, without a shuffle.
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
from .scratch import as_rows, text_of

TERMS = 1 << 18
#: Bytes of the beginnings of longer words that are terms too, so that a stem is known under any ending.
PREFIXES = (4, 6)
CHOSEN = 1024
#: Slots beside which others are tried.
BASES = 64
TRAIN_ROWS = 8000
#: Texts that a term must stand in to be chosen.
LEAST_TEXTS = 6
#: Chi-square of a chosen term; far beyond what the best of ``TERMS`` slots reaches by chance.
LEAST_CHI = 30.0
#: The same beside one of ``BASES`` others, which is as many times as often tried.
LEAST_PAIR_CHI = 36.0
FACTORS = 4


@dataclass(frozen=True)
class Machine:
    column: np.ndarray  # slot of a term -> its weight's place, or -1
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, text: pa.Array) -> np.ndarray:
        out = []
        for rows, row, slot in terms(text, self.column):
            place = self.column[slot]
            linear = np.bincount(row, self.w[place], rows)
            pairs = np.zeros(rows)
            for k in range(self.v.shape[1]):
                own = self.v[place, k]
                pairs += np.bincount(row, own, rows) ** 2 - np.bincount(row, own * own, rows)
            out.append(1 / (1 + np.exp(-np.clip(self.w0 + linear + pairs / 2, -40, 40))))
        return np.concatenate(out) if out else np.empty(0)


def terms(text: pa.Array, column: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, row, slot) of parts of a column: each distinct term slot of each row, or those that have a place in ``column``."""
    data, offsets = wordhash.buffers(text)
    table = wordhash.alphanumeric_words()
    shift = np.uint64(64 - TERMS.bit_length() + 1)
    for a, b in wordhash.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        h, start, end, first = wordhash.words(part, offsets[a : b + 1] - offsets[a], table)
        row = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(first))
        rows, slots = [row], [(h >> shift).astype(np.int64)]
        for n in PREFIXES:
            long = np.flatnonzero(end - start > n)
            at, lead = start[long], np.full(len(long), n, np.uint64)
            for j in range(n):
                lead = wordhash.mix(lead * np.uint64(257) + table[part[at + j]])
            rows.append(row[long])
            slots.append((lead >> shift).astype(np.int64))
        row, slot = np.concatenate(rows), np.concatenate(slots)
        if column is not None:
            known = column[slot] >= 0
            row, slot = row[known], slot[known]
        both = np.unique(row * TERMS + slot)
        yield b - a, both // TERMS, both % TERMS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _without_copies(slots: list[np.ndarray], label: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """One row of each group with the same label and the same two least hashes of uncommon terms: copies of a text would make all its words telling."""
    common = np.bincount(np.concatenate(slots), minlength=TERMS) > max(20, len(slots) // 20)
    seen, keep = set(), []
    for i, own in enumerate(slots):
        own = own[~common[own]]
        key = (label[i], *np.sort(wordhash.mix(own.astype(np.uint64) + np.uint64(1)))[:2].tolist())
        if len(own) < 8 or key not in seen:
            keep.append(i)
        seen.add(key)
    return [slots[i] for i in keep], label[keep]


def _chi_square(seen: np.ndarray, bad: np.ndarray, n: int, n1: float) -> np.ndarray:
    """Of each slot's presence against the label, among n texts, n1 of them with label 1; -1 for slots in too few texts or in all."""
    expected = seen * n1 / n
    spread = expected * (1 - n1 / n) * (1 - seen / n) + 1e-9
    return np.where((seen >= LEAST_TEXTS) & (seen < n), (bad - expected) ** 2 / spread, -1.0)


def fit(slots: list[np.ndarray], label: np.ndarray, steps: int = 300, rate: float = 0.05, ridge: float = 1e-5, seed: int = 7) -> Machine:
    """Fit on rows given as distinct term slots: log-odds weights, then full-batch Adam on the log loss."""
    column = np.full(TERMS, -1, np.int64)
    prior = float(np.clip(label.mean() if len(label) else 0.0, 1e-3, 1 - 1e-3))
    w0 = float(np.log(prior / (1 - prior)))
    if not len(label) or label.min() == label.max():
        return Machine(column, w0, np.zeros(0), np.zeros((0, FACTORS)))
    slots, label = _without_copies(slots, label)
    flat = np.concatenate(slots)
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    seen = np.bincount(flat, minlength=TERMS).astype(float)
    bad = np.bincount(flat, label[row].astype(float), TERMS)
    n, n1 = len(label), float(label.sum())
    told = _chi_square(seen, bad, n, n1)
    worth = np.where(told >= LEAST_CHI, told, 0.0)
    for base in np.argsort(-told, kind="stable")[:BASES].tolist():
        beside = np.zeros(n, bool)
        beside[row[flat == base]] = True
        on, m, m1 = beside[row], int(beside.sum()), float(label[beside].sum())
        if 0 < m1 < m:
            both = _chi_square(np.bincount(flat[on], minlength=TERMS).astype(float), np.bincount(flat[on], label[row[on]].astype(float), TERMS), m, m1)
            worth = np.maximum(worth, np.where(both >= LEAST_PAIR_CHI, both, 0.0))
    best = np.argsort(-worth, kind="stable")[:CHOSEN]
    best = best[worth[best] > 0]
    column[best] = np.arange(len(best))
    x = np.zeros((n, len(best)), np.float32)
    place = column[flat]
    x[row[place >= 0], place[place >= 0]] = 1
    random = np.random.default_rng(seed)
    # starts from each term's own log-odds: telling terms mostly come several at a time, and each must also tell alone
    odds = np.log((bad[best] + 0.5) / (n1 + 1)) - np.log((seen[best] - bad[best] + 3) / (n - n1 + 6))
    value = [np.array([w0], np.float32), np.clip(odds, -4, 6).astype(np.float32), random.normal(0, 0.01, (len(best), FACTORS)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in value], [np.zeros_like(p) for p in value]
    for t in range(1, steps + 1):
        w, v = value[1], value[2]
        xv = x @ v
        z = value[0][0] + x @ w + ((xv * xv).sum(1) - x @ (v * v).sum(1)) / 2
        error = ((_sigmoid(z) - label) / n).astype(np.float32)
        slope = x.T @ error
        grads = [error.sum(keepdims=True), slope + ridge * w / n1, x.T @ (error[:, None] * xv) - slope[:, None] * v + ridge * v]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            value[i] = value[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Machine(column, float(value[0][0]), value[1].astype(float), value[2].astype(float))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[np.ndarray] = []
        for rows, row, slot in terms(batch.column("text")):
            found += np.split(slot, np.searchsorted(row, np.arange(1, rows)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lot", "toxic")), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], names=["doc_id", "lot", "toxic", "slots"])


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that fitting never sees: crc32 of the id's digits leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on up to ``rows`` labelled documents that are not held out, those with the least hash of doc_id; where rows share an id, on as many texts at most. Equal rows count once."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most ``rows`` pairs of numbers are broadcast
    labelled = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("doc_id", "text").alias("lot"), "toxic", "text")
    found = labelled.mapInArrow(released(_features), "doc_id long, lot long, toxic int, slots array<int>").dropDuplicates(["doc_id", "lot", "toxic"])
    found = found.orderBy("lot", "doc_id", "toxic").limit(rows).select("toxic", "slots").toArrow()
    slots = [np.asarray(x.values, np.int64) for x in found["slots"]]
    return fit(slots, np.asarray(found["toxic"], np.float64))


def _scored(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(machine.scores(text_of(batch)))], names=[*kept, "score"])

    return run


def scored_rows(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs (text string, ...) -> (row, score): each row as a struct of its columns, and its score."""
    rows = as_rows(docs)
    return rows.mapInArrow(released(_scored(machine)), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs (doc_id long, text string, ...), labels (doc_id long, toxic int, ...) -> (doc_id, held_out, score), a row for each row of docs.

    score lies in 0 to 1, higher for likelier toxic; a null or empty text gets the
    score of no terms. Rows that repeat a doc_id, or have none, are scored as they
    are. Labels that are null or neither 0 nor 1 are not used; without labels of both kinds all
    scores are the same. An empty table gives an empty one; other columns are ignored.
    """
    machine = train(docs, labels, rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(released(_scored(machine)), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
