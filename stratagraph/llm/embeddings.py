"""Embedding near-dedup over spherical k-means cells.

Unit vectors are assigned to the nearest of k centroids, fitted on a bounded
sample; k grows with the table. Products are taken within cells, in blocks. Two
linked vectors may fall on both sides of a plane between two centroids, so a vector
is also a guest in the cells whose plane is within ``margin`` of it: a pair is lost
only if both are farther from the plane than that. Pairs at the threshold are
sqrt(2 - 2t) apart at most, so with half of that as margin none is lost, whatever the
data (``exact``); but in many dimensions hardly any pair lies straight across a plane,
and that margin makes every vector a guest nearly everywhere. So the margin is
fitted on the sample: pairs at the threshold itself are drawn, in directions in which
the data vary, and it is the least one at which the share ``recall`` of them meet.

A vector is written once, with its cells. Neighbouring cells form groups, and a
group gets each of its vectors once. A cell of more than a group's rows is cut into
blocks, and each pair of blocks is one task's product, so a cell that holds a
third of all vectors is spread over many tasks. A task gives counts of links and one
edge per linked vector, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .components import components
from .memory import released, released_group
from .scratch import Scratch

SAMPLE_ROWS = 16_384
#: Vectors for each cell, until there are MOST_CELLS.
CELL_ROWS = 512
MOST_CELLS = 4096
#: Bytes, as doubles, of the vectors that one task holds; groups that there should be at least.
GROUP_BYTES, LEAST_GROUPS = 8 << 20, 64
#: Share of pairs right at the threshold that should meet in a cell, where not all must; closer pairs meet more often.
RECALL = 0.995
#: Rows of one product.
BLOCK = 512

_DDL = "vec_id long, dims int, d1 long, d2 long, vec binary"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles; rows are first scaled by powers of two, which rounds nothing, so that lengths of huge and tiny ones are finite and not zero."""
    vectors = vectors.astype(np.float64)
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit vectors."""
    random = np.random.default_rng(seed)
    centres = vectors[random.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def apart(centres: np.ndarray, cosine: float) -> np.ndarray:
    """The centroids without those that a kept one is as near to as linked vectors are: what lies there is one dense cell, cut into blocks."""
    close = centres @ centres.T >= cosine
    kept = np.zeros(len(centres), bool)
    for i in range(len(centres)):
        kept[i] = not (close[i] & kept).any()
    return centres[kept]


def reach(cosine: float) -> float:
    """The margin at which no pair is lost."""
    return float(np.sqrt(2 - 2 * cosine) / 2 + 1e-9)


def fitted_margin(vectors: np.ndarray, centres: np.ndarray, cosine: float, recall: float, seed: int = 5) -> float:
    """The least margin at which the share ``recall`` of pairs at the threshold meet; pairs are unit vectors and what lies beside them in the direction between two others."""
    random = np.random.default_rng(seed)
    x = vectors[random.permutation(len(vectors))[:8192]]
    way = vectors[random.integers(len(vectors), size=len(x))] - vectors[random.integers(len(vectors), size=len(x))]
    way -= (way * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(way, axis=1)
    x, way = x[size > 1e-6], way[size > 1e-6] / size[size > 1e-6, None]
    if not len(x):
        return reach(cosine)
    y = cosine * x + np.sqrt(1 - cosine**2) * way
    by_x, by_y, row = x @ centres.T, y @ centres.T, np.arange(len(x))
    a, b = by_x.argmax(1), by_y.argmax(1)
    between = np.maximum(np.linalg.norm(centres[a] - centres[b], axis=1), 1e-12)
    need = np.minimum(by_x[row, a] - by_x[row, b], by_y[row, b] - by_y[row, a]) / between
    return min(reach(cosine), float(np.quantile(need, recall)) + 1e-9)


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dims, digest, vector's bytes) of each row; nulls but for the id where a vector cannot be linked."""
    for batch in batches:
        ids, lists = batch.column("vec_id"), batch.column("embedding")
        first = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists).fill_null(0)), dtype=np.int64)])
        value = lists.flatten().to_numpy(zero_copy_only=False)  # a null becomes NaN
        dims = np.diff(first)
        count = lambda on: (lambda c: c[first[1:]] - c[first[:-1]])(np.concatenate([[0], np.cumsum(on)]))
        sound = (count(~np.isfinite(value)) == 0) & (count(value != 0) > 0) & np.asarray(ids.is_valid())
        value = value + value.dtype.type(0)  # no negative zeros
        bits = value.view(f"u{value.itemsize}").astype(np.uint64)
        place = (np.arange(len(bits)) - np.repeat(first[:-1], dims)).astype(np.uint64)
        digests = []
        for step in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            c = np.concatenate([[np.uint64(0)], np.cumsum(wordhash.mix(bits ^ wordhash.mix((place + np.uint64(1)) * np.uint64(step))), dtype=np.uint64)])
            digests.append(wordhash.mix(c[first[1:]] - c[first[:-1]]).view(np.int64))
        raw = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((first * value.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(value))])
        none = lambda values, kind: pa.array(values, kind, mask=~sound)
        yield pa.RecordBatch.from_arrays([ids, none(dims, pa.int32()), *(none(d, pa.int64()) for d in digests), pc.if_else(pa.array(sound), raw, None)], names=["vec_id", "dims", "d1", "d2", "vec"])


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Unit vectors of a column of vectors' bytes."""
    data, offsets = wordhash.buffers(column)
    return unit(data.view(kind).reshape(len(offsets) - 1, -1))


def _assigned(centres: np.ndarray, margin: float, kind: str):
    """Adds the cell that a vector lies in, and those that it is a guest in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = centres.astype(np.float64)
        span = np.sqrt(np.maximum(2 - 2 * centre @ centre.T, 0))
        step = max(1, (1 << 20) // len(centre))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                near = _matrix(batch.column("vec"), kind) @ centre.T
                row, home = np.arange(len(near)), np.argmax(near, axis=1)
                visits = near[row, home][:, None] - near <= margin * span[home]
                visits[row, home] = False
                guest, cell = np.nonzero(visits)
                seen = pa.ListArray.from_arrays(pa.array(np.searchsorted(guest, np.arange(len(near) + 1)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), seen], names=[*batch.schema.names, "home", "seen"])

    return run


def chained(centres: np.ndarray) -> np.ndarray:
    """The centroids in an order in which each is followed by the nearest one left."""
    near, left, at = centres @ centres.T, np.ones(len(centres), bool), 0
    out = []
    for _ in range(len(centres)):
        out.append(at)
        left[at] = False
        at = int(np.argmax(np.where(left, near[at], -2)))
    return np.array(out)


def grouped(order: np.ndarray, members: np.ndarray, guests: np.ndarray, most: int) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """(group of each cell, blocks of members and of guests of each group that is one large cell); no other group has over ``most`` rows."""
    group, split, now, room = np.zeros(len(order), np.int64), {}, -1, 0
    half = max(1, most // 2)  # two blocks meet in a task
    for cell in order.tolist():
        rows = int(members[cell] + guests[cell])
        if rows > most:
            now, room = now + 1, 0
            split[now] = (-(-int(members[cell]) // half), -(-int(guests[cell]) // half))
        elif rows > room:
            now, room = now + 1, most - rows
        else:
            room -= rows
        group[cell] = now
    return group, split


def _dealt(group: np.ndarray, split: dict[int, tuple[int, int]]):
    """A row for each task that a vector takes part in: one for each group, and of a cut cell one for each other block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.zeros(int(group.max()) + 1, bool)
        cut[list(split)] = True
        for batch in batches:
            home, seen, node = np.asarray(batch.column("home"), np.int64), batch.column("seen"), np.asarray(batch.column("node"))
            size = np.diff(np.asarray(seen.offsets))
            row = np.concatenate([np.arange(len(home)), np.repeat(np.arange(len(home)), size)])
            cell = np.concatenate([home, np.asarray(seen.flatten(), np.int64)])
            plain = ~cut[group[cell]]
            once = np.unique(row[plain] * len(cut) + group[cell[plain]])
            rows, tasks, blocks = [once // len(cut)], [once % len(cut) << 40], [np.zeros(len(once), np.int64)]
            lot = wordhash.mix(node.view(np.uint64))
            for g, (own, other) in split.items():
                for member in (True, False):
                    at = row[(group[cell] == g) & ((home[row] == cell) == member)]
                    if not len(at):
                        continue
                    block = (lot[at] % np.uint64(own if member else other)).astype(np.int64) + (0 if member else own)
                    meets = np.arange(own + other if member else own)
                    i, j = np.minimum(block[:, None], meets), np.maximum(block[:, None], meets)
                    rows.append(np.repeat(at, len(meets)))
                    tasks.append(((g << 40) + (i << 20) + j).ravel())
                    blocks.append(np.repeat(block, len(meets)))
            rows, tasks, blocks = (np.concatenate(x) for x in (rows, tasks, blocks))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(tasks), pa.array(blocks, pa.int32()), *(batch.column(c).take(take) for c in ("node", "copies", "home", "seen", "vec"))], names=["task", "block", "node", "copies", "home", "seen", "vec"])

    return run


class _Links:
    """Counts of links of the rows of one task, and for each the least row that links reach."""

    def __init__(self, vectors: np.ndarray, copies: np.ndarray, cosine: float):
        self.vectors, self.copies, self.cosine = vectors, copies.astype(np.float64), cosine
        self.count, self.low = np.zeros(len(copies)), np.arange(len(copies))

    def meet(self, left: np.ndarray, right: np.ndarray, elsewhere: np.ndarray | None = None) -> None:
        """Link rows of ``left`` with rows of ``right``, or among themselves if these are the same; pairs ``elsewhere`` count in another cell."""
        among = left is right
        for at in range(0, len(left), BLOCK):
            own = left[at : at + BLOCK]
            near = self.vectors[own] @ self.vectors[right].T >= self.cosine
            if among:
                near[np.arange(len(own)), at + np.arange(len(own))] = False
            if elsewhere is not None:
                near &= ~elsewhere[at : at + BLOCK]
            if not near.any():
                continue
            weight = near.astype(np.float64)
            self.count[own] += weight @ self.copies[right]
            if not among:
                self.count[right] += weight.T @ self.copies[own]
            while True:
                a, b = np.nonzero(near & (self.low[own][:, None] != self.low[right][None]))
                if not len(a):
                    break
                x, y = self.low[own[a]], self.low[right[b]]
                np.minimum.at(self.low, np.maximum(x, y), np.minimum(x, y))
                while (self.low != self.low[self.low]).any():
                    self.low = self.low[self.low]


def _linked(cosine: float, kind: str, group: np.ndarray, split: dict[int, tuple[int, int]]):
    """Link counts and edges of one task. A pair counts in a cell where one lies and the other lies or is a guest, in the lower one of two such cells."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        task = key[0].as_py()
        g, i, j = task >> 40, task >> 20 & 0xFFFFF, task & 0xFFFFF
        table = table.sort_by("node")
        node, home, block = (np.asarray(table[c]) for c in ("node", "home", "block"))
        links = _Links(_matrix(table["vec"], kind), np.asarray(table["copies"]), cosine)
        seen = table["seen"].combine_chunks()
        size = np.diff(np.asarray(seen.offsets))
        row, goes = np.repeat(np.arange(len(node)), size), np.asarray(seen.flatten())

        def elsewhere(cell: int, members: np.ndarray, guests: np.ndarray) -> np.ndarray:
            lower = np.unique(home[guests][home[guests] < cell])
            place = np.full(len(node), -1)
            place[members] = np.arange(len(members))
            on = (place[row] >= 0) & np.isin(goes, lower)
            visits = np.zeros((len(members), len(lower) + 1), bool)
            visits[place[row[on]], np.searchsorted(lower, goes[on])] = True
            return visits[:, np.where(home[guests] < cell, np.searchsorted(lower, home[guests]), len(lower))]

        if g in split:
            cell = int(np.flatnonzero(group == g)[0])
            left = np.flatnonzero(block == i)
            if i == j:
                links.meet(left, left)
            else:
                right = np.flatnonzero(block == j)
                links.meet(left, right, None if j < split[g][0] else elsewhere(cell, left, right))
        else:
            for cell in np.unique(home[group[home] == g]).tolist():
                members, guests = np.flatnonzero(home == cell), np.unique(row[goes == cell])
                links.meet(members, members)
                if len(guests):
                    links.meet(members, guests, elsewhere(cell, members, guests))
        on = np.flatnonzero(links.count)
        return pa.table([pa.array(node[on]), pa.array(links.count[on].astype(np.int64)), pa.array(node[links.low[on]])], names=["node", "links", "low"])

    return run


def _links_of(own: DataFrame, n: int, dims: int, kind: str, cosine: float, recall: float | None, scratch: Scratch) -> DataFrame:
    """own (node, copies, vec), ``n`` vectors of ``dims`` components -> (node, links, low), more than one row for some."""
    k = max(1, min(MOST_CELLS, n // CELL_ROWS))
    sample = own.orderBy(F.xxhash64("node"), "node").limit(min(SAMPLE_ROWS, 64 * k)).select("vec").toArrow()
    units = _matrix(sample["vec"], kind)
    centres = apart(spherical_kmeans(units, k), cosine)
    margin = reach(cosine) if recall is None else fitted_margin(units, centres, cosine, recall)
    placed = own.mapInArrow(released(_assigned(centres.astype(np.float32), margin, kind)), "node long, copies long, vec binary, home int, seen array<int>")
    placed = scratch.save(placed, "placed")
    # MOST_CELLS rows at most
    cells = placed.select("home", F.explode(F.concat(F.array("home"), "seen")).alias("cell")).groupBy("cell").agg(F.count("*").alias("rows"), F.sum((F.col("home") == F.col("cell")).cast("long")).alias("members")).collect()
    members, guests = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
    for r in cells:
        members[r.cell], guests[r.cell] = r.members, r.rows - r.members
    most = max(BLOCK, min(GROUP_BYTES // (8 * dims), int((members + guests).sum()) // LEAST_GROUPS))
    group, split = grouped(chained(centres), members, guests, most)
    dealt = placed.mapInArrow(released(_dealt(group, split)), "task long, block int, node long, copies long, home int, seen array<int>, vec binary")
    found = scratch.save(dealt.groupBy("task").applyInArrow(released_group(_linked(cosine, kind, group, split)), "node long, links long, low long"), "links", "node")
    scratch.drop(placed)
    return found


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float | None = None) -> DataFrame:
    """vectors (vec_id long, embedding array of float or double, ...) -> (vec_id, n_links, component_id, kept), a row for each row.

    Vectors with a cosine of ``cosine`` or more, ties included, are linked, whatever other columns
    say; n_links counts the other rows linked directly, component_id is the least
    vec_id that links reach, kept marks rows whose vec_id that is. All pairs are found, or with
    ``recall`` about that share of those right at the threshold, and more of closer ones; never one below. Vectors
    that are null, empty, zero, or hold nulls or numbers that are not finite link
    with nothing; vectors of unlike lengths do not link with each other. Equal
    vectors are compared once and count as many. Rows that repeat a vec_id are vectors of
    their own: an id links nothing, and equal ones all have the fate of that id. Rows without vec_id are kept,
    and have no part in links. An empty table gives an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("embedding") if element in ("float", "double") else F.col("embedding").cast("array<double>")).alias("embedding"))
    rows = rows.mapInArrow(released(_prepared), _DDL)
    named = rows.where("d1 is not null").groupBy("dims", "d1", "d2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = scratch.save(named.withColumn("node", F.monotonically_increasing_id()), "classes")
    parts = [
        _links_of(classes.where(F.col("dims") == r.dims).select("node", "copies", "vec"), r.n, r.dims, kind, cosine, recall, scratch)
        for r in classes.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect()
    ]
    keys = classes.select("dims", "d1", "d2", "node", "id", "copies")
    if parts:
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        labels = scratch.save(components(scratch, found.select(F.col("node").alias("a"), F.col("low").alias("b"))), "labels")
        least = labels.join(keys.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
        linked = labels.join(least, "component").select("node", "least")
        keys = keys.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(linked, "node", "left")
    else:
        keys = keys.withColumns({"links": F.lit(0).cast("long"), "least": F.col("id")})
    keys = keys.select("dims", "d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "id").alias("least"))
    # written, so that the join may split the partition of a vector that very many rows have
    out = rows.drop("vec").join(scratch.save(keys, "keys"), ["dims", "d1", "d2"], "left")
    scratch.drop(classes)
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
