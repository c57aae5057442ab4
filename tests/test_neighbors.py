"""Exact neighbours by pivot cells against all distances: ties, crowded cells, few rows."""

import numpy as np
import pytest

from propkit.operators import neighbors as N


def brute(T, Q, k):
    out = {}
    for i, q in enumerate(Q):
        d = ((T - q) ** 2).sum(1)
        out[i] = np.lexsort((np.arange(len(T)), np.round(d, 9)))[:k].tolist()
    return out


def frames(spark, T, Q):
    t = spark.createDataFrame([(i, x.tolist(), float(i)) for i, x in enumerate(T)], "row_id long, vector array<double>, y double")
    return t.repartition(4), spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(Q)], "row_id long, vector array<double>").repartition(3)


def data(kind):
    rng = np.random.default_rng(2)
    if kind == "clusters":
        c = rng.normal(0, 10, (12, 6))
        return c[rng.integers(0, 12, 900)] + rng.normal(0, 1, (900, 6)), c[rng.integers(0, 12, 150)] + rng.normal(0, 1, (150, 6))
    if kind == "crowded":  # two thirds of the rows in one spot
        return np.concatenate([rng.normal(0, 1e-3, (600, 3)), rng.normal(0, 5, (300, 3))]), rng.normal(0, 2, (80, 3))
    if kind == "ties":
        grid = np.stack(np.meshgrid(range(8), range(8), range(8)), -1).reshape(-1, 3).astype(float)
        return grid, rng.integers(0, 8, (60, 3)).astype(float)
    if kind == "same":
        return np.ones((50, 2)), np.ones((5, 2))
    return rng.normal(0, 1, (3, 4)), rng.normal(0, 1, (7, 4))  # fewer rows than neighbours


@pytest.mark.parametrize("kind", ["clusters", "crowded", "ties", "same", "few"])
def test_against_all_distances(spark, kind):
    T, Q = data(kind)
    t, q = frames(spark, T, Q)
    got = {}
    for r in sorted(N.nearest(t, q, k=5, block_rows=64).collect(), key=lambda r: (r.qid, round(r.dist, 9), r.tid)):
        got.setdefault(r.qid, []).append(r.tid)
    assert got == brute(T, Q, 5)
    if kind == "clusters":
        pred = {r.row_id: r.y_pred for r in N.knn_regress(t, q, k=3).collect()}
        assert all(abs(pred[i] - np.mean(b)) < 1e-9 for i, b in brute(T, Q, 3).items())


def test_cells_are_pruned(spark, monkeypatch):
    """Far fewer visits than queries times cells."""
    T, Q = data("clusters")
    t, q = frames(spark, T, Q)
    monkeypatch.setattr(N, "QUERY_BATCHES", 0.01)  # as many copies as very many queries would make
    seen, searched = [], N._searched
    monkeypatch.setattr(N, "_searched", lambda train, queries, *a: seen.append(queries.count()) or searched(train, queries, *a))
    got = {}
    for r in sorted(N.nearest(t, q, k=5).collect(), key=lambda r: (r.qid, round(r.dist, 9), r.tid)):
        got.setdefault(r.qid, []).append(r.tid)
    assert got == brute(T, Q, 5)
    cells = len(N.pivots_of(t.selectExpr("row_id as id", "vector as x"), 30))
    assert seen[0] == len(Q) and sum(seen) < 0.4 * len(Q) * cells


def test_no_rows(spark):
    t, q = frames(spark, np.zeros((0, 2)), np.ones((2, 2)))
    assert N.knn_regress(t, q).count() == 0
    t, q = frames(spark, np.ones((2, 2)), np.zeros((0, 2)))
    assert N.knn_regress(t, q).count() == 0


def test_visits_do_not_grow_with_the_cells(spark):
    """Where no cell can be ruled out a query goes to each other group once, in batches of bounded size."""
    import pyarrow as pa
    rng = np.random.default_rng(4)
    pivots, rows = rng.normal(0, 1, (1000, 3)), np.full(1000, 100)
    groups = N.groups_of(rows, 4096)
    assert np.bincount(groups).max() == 40 and (np.diff(groups) >= 0).all() and groups[-1] == 24
    assert N.groups_of(np.array([5000, 10, 9000, 0, 20]), 4096).tolist() == [0, 1, 2, 3, 3]
    x = pa.array(rng.normal(0, 1, (2000, 3)).tolist(), pa.list_(pa.float64()))
    own = np.arange(2000, dtype=np.int32) % 1000
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), x, pa.array(own), pa.array(np.full(2000, np.inf))], names=["id", "x", "cell", "bound"])
    got = list(N._visits(pivots, np.ones(1000), rows, groups)(iter([batch])))
    assert sum(b.num_rows for b in got) == 2000 * 24 and max(b.num_rows for b in got) <= 4096


def test_search_in_groups_of_cells(spark, monkeypatch):
    """Many groups, small blocks of distances, queries that come in several copies."""
    monkeypatch.setattr(N, "PAIRS", 4096)
    monkeypatch.setattr(N, "MAX_PIVOTS", 64)
    rng = np.random.default_rng(9)
    T, Q = rng.normal(0, 1, (700, 16)), rng.normal(0, 1, (90, 16))
    t, q = frames(spark, T, Q)
    got = {}
    for r in sorted(N.nearest(t, q, k=4, block_rows=20).collect(), key=lambda r: (r.qid, round(r.dist, 9), r.tid)):
        got.setdefault(r.qid, []).append(r.tid)
    assert got == brute(T, Q, 4)
