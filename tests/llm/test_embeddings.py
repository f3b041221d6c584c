"""Embedding near-dedup against brute force."""

import numpy as np
import pytest

from stratagraph.llm import embeddings

DDL = "vec_id long, embedding array<float>"


def linked(x, cosine=0.9):
    u = embeddings.unit(x)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    return near


def components(near, ids):
    low = np.array(ids)
    while True:
        new = np.array([min([low[i], *low[near[i]]]) for i in range(len(low))])
        if (new == low).all():
            return low
        low = new


def vectors(seed, n, dims=32):
    """Half in groups of drifting copies, half spread out."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 20, dims))
    near = centres[r.integers(len(centres), size=n // 2)] + r.normal(size=(n // 2, dims)) * r.choice([0.05, 0.2, 0.33], size=(n // 2, 1))
    return np.concatenate([near, r.normal(size=(n - n // 2, dims))]).astype(np.float32)


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x)], DDL)


def test_recall_with_cells_of_their_real_size(spark):
    x = vectors(3, 6000)
    near = linked(x)
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(frame(spark, x), recall=embeddings.RECALL).collect()}
    counts = np.array([got[i] for i in range(len(x))])
    assert (counts <= near.sum(1)).all()  # none below the threshold
    assert counts.sum() >= 0.99 * near.sum() > 10_000
    exact = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(frame(spark, x)).collect()}
    low = components(near, range(len(x)))
    assert exact == {i: (int(near[i].sum()), int(low[i])) for i in range(len(x))}


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    """One dense group of over half the rows, beside others, in tasks of few rows."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=16) + 0.25 * r.normal(size=(700, 16)), vectors(6, 500, 16)]).astype(np.float32)
    monkeypatch.setattr(embeddings, "CELL_ROWS", 60)
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    monkeypatch.setattr(embeddings, "LEAST_GROUPS", 1000)
    near = linked(x)
    low = components(near, range(len(x)))
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in embeddings.near_vectors(frame(spark, x)).collect()}
    assert got == {i: (int(near[i].sum()), int(low[i]), bool(low[i] == i)) for i in range(len(x))}


def test_groups_and_blocks():
    order = np.arange(6)
    group, split = embeddings.grouped(order, np.array([3, 3, 40, 2, 2, 9]), np.array([1, 1, 25, 0, 3, 0]), 10)
    assert group.tolist() == [0, 0, 1, 2, 2, 3] and split == {1: (8, 5)}


def test_rows_that_share_an_id(spark):
    turn = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.1], [0.1, 1.0]]
    rows = [(5, turn[0]), (5, turn[1]), (7, turn[2]), (8, turn[3]), (9, turn[0]), (9, turn[0]), (None, turn[0])]
    got = sorted((tuple(r) for r in embeddings.near_vectors(spark.createDataFrame(rows, DDL)).collect()), key=str)
    # an id links nothing: its two vectors each have their own links
    assert got == sorted([(5, 3, 5, True), (5, 1, 5, True), (7, 3, 5, False), (8, 1, 5, False), (9, 3, 5, False), (9, 3, 5, False), (None, 0, None, True)], key=str)


def test_ties_count(spark):
    # 9 / (1 * 10) is 0.9 itself
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [18.0, -6.0, 6.0, 2.0]), (4, [8.9, 3.2, 3.0, 1.0])]
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 1}


@pytest.mark.parametrize("kind", ["float", "double", "decimal(9,3)", "int"])
def test_columns_and_types(spark, kind):
    rows = spark.createDataFrame([(1, [3.0, 4.0], "x", 1, "y", "z", 2), (2, [6.0, 8.0], "x", 1, "y", "z", 2), (3, [-3.0, 4.0], "x", 1, "y", "z", 2)], "vec_id int, embedding array<double>, home string, node int, `a.b` string, n_links string, id int")
    rows = rows.withColumn("embedding", rows.embedding.cast(f"array<{kind}>"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(rows).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_huge_and_tiny_numbers(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [-0.0, 1.0]), (4, [0.0, 2.0]), (5, [5e-324, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}
