"""Exact k-nearest-neighbour regression (J5 / M7) by pivot cells.

Train rows are assigned to the nearest of a bounded number of *pivots* (train rows in hash
order); a cell knows its rows and its radius.  A query first searches the cell of its own
nearest pivot, which bounds the distance of its ``k``-th neighbour.  It then visits only the
cells that the triangle inequality cannot rule out: those whose pivot is no farther than that
bound plus the radius, and whose half-plane against the query's own pivot it can reach.

Cells next to each other share a group of up to ``block_rows`` rows, and a query goes to a group
once, with its bound, however many of its cells it may reach: vectors of many dimensions reach
nearly all cells, and then the work is a matrix product for each group and batch of queries.
Cells of more than ``block_rows`` rows are cut into parts, and parts that very many queries
visit are copied, so no task holds more than ``block_rows`` train rows, a batch of queries
and ``PAIRS`` distances, however crowded a cell is and however many rows there are.  A search emits the ``k`` best rows of a part, never the
pairs; the best ``k`` over the parts are exact.  Ties break on the train id.  The
prediction is the mean target (uniform weights).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propkit.session import cut_lineage

MAX_PIVOTS = 1024  # the pivots are the only thing that every task holds
BLOCK_ROWS = 16384  # train rows of a group
QUERY_BATCHES = 4  # queries (in units of block_rows) that one copy of a part answers
PAIRS = 1 << 20  # distances that a task holds at a time


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2.0 * a @ b.T + (b * b).sum(1)[None, :], 0.0)


def pivots_of(train: DataFrame, count: int) -> np.ndarray:
    """Distinct train vectors, first in the hash order of their ids."""
    got = train.select("x", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(count).collect()
    return np.unique(np.array([r["x"] for r in got], float), axis=0) if got else np.zeros((0, 0))


def _nearest(pivots: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x, step = _matrix(batch.column(1), pivots.shape[1]), PAIRS // MAX_PIVOTS
    cell, far = np.zeros(len(x), np.int32), np.zeros(len(x))
    for lo in range(0, len(x), step):
        d = _square(x[lo: lo + step], pivots)
        cell[lo: lo + step] = d.argmin(1)
        far[lo: lo + step] = np.sqrt(d.min(1))
    return cell, far


def _assigned(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = _nearest(pivots, batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])
    return run


def groups_of(rows: np.ndarray, block_rows: int) -> np.ndarray:
    """The group of every cell: cells in a row, of together at most ``block_rows`` rows, or one cell alone."""
    out, group, held = np.zeros(len(rows), np.int32), 0, 0
    for cell, n in enumerate(rows.tolist()):
        if held and held + n > block_rows:
            group, held = group + 1, 0
        out[cell], held = group, held + n
    return out


def _visits(pivots: np.ndarray, radius: np.ndarray, rows: np.ndarray, groups: np.ndarray):
    """The other groups with cells that a query with a bound may find a neighbour in."""
    between = np.sqrt(_square(pivots, pivots))
    first = np.flatnonzero(np.diff(groups, prepend=-1))  # cells of a group stand in a row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = PAIRS // MAX_PIVOTS
        for batch in batches:
            q, own, bound = _matrix(batch.column(1), pivots.shape[1]), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for lo in range(0, len(q), step):
                part = slice(lo, lo + step)
                d2 = _square(q[part], pivots)
                d, mine = np.sqrt(d2), own[part]
                slack = 1e-6 * (1.0 + d)  # rounding never loses a neighbour
                reach = bound[part][:, None] + slack
                apart = between[mine]
                plane = (d2 - d2[np.arange(len(mine)), mine][:, None]) / np.where(apart > 0, 2.0 * apart, np.inf)
                ok = (d - radius[None, :] <= reach) & (plane <= reach) & (rows[None, :] > 0)
                ok = np.logical_or.reduceat(ok, first, axis=1)
                ok[np.arange(len(mine)), groups[mine]] = False
                i, group = np.nonzero(ok)
                for b in range(0, len(i), 4 * step):  # a query may visit very many groups
                    at = pa.array(i[b: b + 4 * step] + lo)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(group[b: b + 4 * step].astype(np.int32)),
                                                      batch.column(3).take(at)], names=["id", "x", "cell", "bound"])
    return run


def _search(k: int, dim: int):
    """Rows come part by part, the train rows before the queries; the last number of a query is its bound."""
    def best(train: list, q: np.ndarray, qid: np.ndarray, bound: np.ndarray) -> Iterator[pa.RecordBatch]:
        X, tid, ty = (np.concatenate(c) for c in zip(*train))
        train[:] = [(X, tid, ty)]
        kk, chunk = min(k, len(X)), max(1, PAIRS // len(X))
        within = (bound + 1e-6 * (1.0 + bound)) ** 2  # rounding never loses a neighbour
        for lo in range(0, len(q), chunk):
            d2, limit = _square(q[lo: lo + chunk], X), within[lo: lo + chunk].copy()
            # the k-th distance where the bound leaves many rows, then all rows within it
            wide = np.flatnonzero(np.count_nonzero(d2 <= limit[:, None], axis=1) > 16 * kk) if kk < len(X) else []
            if len(wide):
                limit[wide] = np.minimum(limit[wide], np.partition(d2[wide], kk - 1, axis=1)[:, kk - 1])
            row, col = np.nonzero(d2 <= limit[:, None])
            order = np.lexsort((tid[col], d2[row, col], row))
            row, col = row[order], col[order]
            first = np.searchsorted(row, np.arange(len(d2)))
            keep = np.arange(len(row)) - first[row] < kk
            row, col = row[keep], col[keep]
            yield pa.RecordBatch.from_arrays([pa.array(qid[lo: lo + chunk][row]), pa.array(tid[col]), pa.array(d2[row, col]), pa.array(ty[col])],
                                             names=["qid", "tid", "dist", "ty"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, train = None, []
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            kind, ids, x = batch.column(3).to_numpy(), batch.column(4).to_numpy(), _matrix(batch.column(5), dim)
            y = batch.column(6).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.any(place[1:] != place[:-1], axis=1) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(place)]):
                if lo == hi:
                    continue
                if at != tuple(place[lo]):
                    at, train = tuple(place[lo]), []
                if kind[lo] == 0:
                    train.append((x[lo:hi], ids[lo:hi], y[lo:hi]))
                elif train:
                    yield from best(train, x[lo:hi], ids[lo:hi], y[lo:hi])
    return run


def _visited(queries: DataFrame) -> dict[int, int]:
    """Queries of each group (at most ``MAX_PIVOTS`` rows)."""
    return {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}


def _searched(train: DataFrame, queries: DataFrame, k: int, dim: int, block_rows: int, rows: dict[int, int], asked: dict[int, int]) -> DataFrame:
    """The ``k`` best rows within the bound of every visited part for ``queries`` (id, x, cell, bound); ``cell`` is a group."""
    spark = train.sparkSession
    shape = spark.createDataFrame([(c, math.ceil(n / block_rows), max(1, math.ceil(asked[c] / (QUERY_BATCHES * block_rows))))
                                   for c, n in rows.items() if c in asked], "c int, parts int, copies int")
    on = lambda df: df.join(F.broadcast(shape), F.col("cell") == F.col("c"))
    range_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    t = on(train).select("cell", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("part"), range_("copies").alias("copy"),
                         F.lit(0).alias("kind"), "id", "x", "y")
    q = on(queries).select("cell", range_("parts").alias("part"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("copies")).cast("int").alias("copy"),
                           F.lit(1).alias("kind"), "id", "x", F.col("bound").alias("y"))
    x = t.unionByName(q).repartition("cell", "part", "copy").sortWithinPartitions("cell", "part", "copy", "kind")
    return x.mapInArrow(_search(k, dim), "qid long, tid long, dist double, ty double")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("dist", "tid")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)


def nearest(train: DataFrame, query: DataFrame, k: int = 5, id_col: str = "row_id", vec_col: str = "vector",
            y_col: str = "y", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(qid, tid, dist, ty)``: the ``k`` nearest train rows (squared distance) of every query row."""
    prepared = lambda df, *more: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"), *more)
    t, q = prepared(train, F.col(y_col).cast("double").alias("y")), prepared(query)
    n = t.count()
    pivots = pivots_of(t, min(MAX_PIVOTS, max(1, math.isqrt(n))))
    empty = train.sparkSession.createDataFrame([], "qid long, tid long, dist double, ty double")
    if not len(pivots):
        return empty
    dim = pivots.shape[1]
    t = cut_lineage(t.mapInArrow(_assigned(pivots), "id long, x array<double>, y double, cell int, far double"))
    q = cut_lineage(q.mapInArrow(_assigned(pivots), "id long, x array<double>, cell int, far double"))
    rows, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in t.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
        rows[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    groups = groups_of(rows, block_rows)
    group = F.expr(f"element_at(array({', '.join(map(str, groups.tolist()))}), cell + 1)").alias("cell")
    sizes = {g: n for g, n in enumerate(np.bincount(groups, weights=rows).astype(int).tolist()) if n}
    t, mine = t.select("id", "x", "y", group), q.select("id", "x", group, F.lit(float("inf")).alias("bound"))
    asked = _visited(mine)
    own = cut_lineage(_searched(t, mine, k, dim, block_rows, sizes, asked))
    # the k-th distance in the own group bounds the search; with fewer rows there, no bound
    bound = _top(own, k).groupBy("qid").agg(F.count(F.lit(1)).alias("m"), F.max("dist").alias("d"))
    bounded = q.join(bound, F.col("id") == F.col("qid"), "left").select(
        "id", "x", "cell", F.when(F.col("m") >= k, F.sqrt("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    visits = bounded.mapInArrow(_visits(pivots, radius, rows, groups), "id long, x array<double>, cell int, bound double")
    everyone = sum(asked.values())
    # with few queries no part needs a copy, and visits need not be counted
    asked = dict.fromkeys(sizes, everyone) if everyone <= QUERY_BATCHES * block_rows else _visited(visits)
    others = _searched(t, visits, k, dim, block_rows, sizes, asked)
    return _top(own.unionByName(others), k).drop("_r")


def knn_regress(train: DataFrame, query: DataFrame, k: int = 5, id_col: str = "row_id",
                vec_col: str = "vector", y_col: str = "y", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean target of the ``k`` nearest train rows (squared Euclidean) for every query row.

    Returns (row_id, y_pred).
    """
    best = nearest(train, query, k, id_col, vec_col, y_col, block_rows)
    return best.groupBy(F.col("qid").alias(id_col)).agg(F.avg("ty").alias("y_pred"))
