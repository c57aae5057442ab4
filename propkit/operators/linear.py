"""Linear and ridge regression from sufficient statistics.

One aggregate over the data gives, for every fold, the matrix of products of
``[1, x, y]``.  A training set that leaves a fold out is the sum of the other folds'
matrices, and the error on the fold follows from its own matrix, so every fold, every
``alpha`` and every candidate is solved from ``folds x (d + 2)**2`` numbers, without
another pass.  Values are taken relative to one row, which keeps the products small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINEAR_MODELS = ("linear_regression", "ridge")


def _products(groups: int, shift: np.ndarray):
    dim = len(shift) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, dim, dim))
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
            z = np.column_stack([np.ones(len(x)), x, batch.column(2).to_numpy(zero_copy_only=False)])
            z[:, 1:] -= shift
            for k in np.unique(g):
                part = z[g == k]
                total[k] += part.T @ part
        group, row = (a.ravel() for a in np.indices((groups, dim)))
        offsets = pa.array(np.arange(0, groups * dim * dim + 1, dim, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(row.astype(np.int32)),
                                          pa.ListArray.from_arrays(offsets, pa.array(total.reshape(-1)))], names=["g", "i", "row"])
    return run


class Products:
    """Per group the products of ``[1, x - shift, y - shift]``: an array (groups, d + 2, d + 2)."""

    def __init__(self, g: np.ndarray, shift: np.ndarray):
        self.g, self.shift = g, shift

    @staticmethod
    def of(data: DataFrame, group, groups: int, label: str = "y", vec_col: str = "vector") -> "Products | None":
        """One aggregate over ``data``; None when it has no rows."""
        d = data.select(group.cast("int").alias("g"), F.col(vec_col).alias("x"), F.col(label).cast("double").alias("y"))
        one = d.first()
        if one is None:
            return None
        shift = np.array([*one["x"], one["y"]], float)
        rows = d.mapInArrow(_products(groups, shift), "g int, i int, row array<double>")
        summed = rows.groupBy("g", "i").agg(Summarizer.sum(array_to_vector("row")).alias("s")).collect()
        out = np.zeros((groups, len(shift) + 1, len(shift) + 1))
        for r in summed:
            out[r["g"], r["i"]] = r["s"].toArray()
        return Products(out, shift)

    def solve(self, groups: list[int], alpha: float = 0.0, intercept: bool = True) -> np.ndarray:
        """``[b0, b]`` in shifted coordinates, fitted on these groups: least squares plus
        ``alpha`` times the squared length of ``b`` (the shortest one where several fit)."""
        m = self.g[groups].sum(0)
        if intercept:
            n = m[0, 0]
            mean = m[0, 1:] / n if n else np.zeros(len(m) - 1)
            c = m[1:, 1:] - n * np.outer(mean, mean)
        else:  # around the origin: undo the shift
            c = self.around(m, -self.shift)
        a, b = c[:-1, :-1] + alpha * np.eye(len(c) - 1), c[:-1, -1]
        beta = np.linalg.solve(a, b) if alpha > 0 else np.linalg.lstsq(a, b, rcond=1e-13)[0]
        if intercept:
            return np.concatenate([[mean[-1] - mean[:-1] @ beta], beta])
        return np.concatenate([[self.shift[:-1] @ beta - self.shift[-1]], beta])

    def around(self, m: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The products of ``[x, y]`` moved by ``-shift`` more."""
        s = m[0, 1:]
        return m[1:, 1:] - np.outer(shift, s) - np.outer(s, shift) + m[0, 0] * np.outer(shift, shift)

    def r2(self, group: int, coefficients: np.ndarray) -> float | None:
        """R² on one group; None where its target is constant or it has no rows."""
        m = self.g[group]
        v = np.concatenate([-coefficients, [1.0]])
        n = m[0, 0]
        total = m[-1, -1] - m[0, -1] ** 2 / n if n else 0.0
        if n == 0 or total <= 1e-12 * max(m[-1, -1], 1e-300):
            return None
        return float(1.0 - v @ m @ v / total)


def fold_of(seed: int, folds: int, id_col: str = "row_id"):
    """Fold of a row by the md5 of the seed and its id: the same on every engine."""
    h = F.md5(F.concat(F.lit(f"{seed}:fold:"), F.col(id_col).cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("long"), F.lit(folds))


def fold_scores(data: DataFrame, fold, folds: int, candidates: list[dict], model: str, label: str = "y") -> list[list[float | None]]:
    """R² of every candidate (``alpha``, ``fit_intercept``) on every fold, from one aggregate."""
    p = Products.of(data, fold, folds, label)
    if p is None:
        return [[None] * folds for _ in candidates]
    out = []
    for c in candidates:
        alpha = float(c.get("alpha", 1.0)) if model == "ridge" else 0.0
        if alpha < 0 or not math.isfinite(alpha):
            raise ValueError(f"alpha must not be negative: {alpha}")
        rest = [[g for g in range(folds) if g != f] for f in range(folds)]
        out.append([p.r2(f, p.solve(rest[f], alpha, bool(c.get("fit_intercept", True)))) for f in range(folds)])
    return out
