"""Sufficient statistics against separate fits, and draws by buckets."""

import numpy as np
import pytest

from propkit.operators import linear
from propkit.operators import model as M
from propkit.operators.evaluate import regression_metrics


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(20, 2, (300, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 100 + rng.normal(0, 1, 300)
    return spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "row_id long, vector array<double>, y double").repartition(3).cache()


def separate(data, model, params, folds, seed):
    d = M._with_features(data.withColumn("fold", linear.fold_of(seed, folds)))
    return [regression_metrics(M._fit(model, params, d.where(f"fold <> {f}"), "y", seed).transform(d.where(f"fold = {f}")), "y", "prediction").first()["r2"]
            for f in range(folds)]


@pytest.mark.parametrize("model,params", [("linear_regression", {}), ("ridge", {"alpha": 3.0}), ("ridge", {"alpha": 0.5, "fit_intercept": False}),
                                          ("linear_regression", {"fit_intercept": False})])
def test_folds_equal_separate_fits(data, model, params):
    got = [r.r2 for r in M.cross_validate(data, model, params, folds=4, seed=1).orderBy("fold").collect()]
    assert np.allclose(got, separate(data, model, params, 4, 1), atol=1e-9)


def test_grid_reads_the_data_once(spark, data, monkeypatch):
    calls, of = [], linear.Products.of
    monkeypatch.setattr(linear.Products, "of", staticmethod(lambda *a, **k: calls.append(1) or of(*a, **k)))
    best, table = M.grid_scores(data, "ridge", {"alpha": [0.01, 1.0, 100.0]}, folds=3)
    assert len(calls) == 1 and table.count() == 3 and best["alpha"] in (0.01, 1.0, 100.0)
    _, hist = M.halving_scores(data, "ridge", {"alpha": [0.01, 0.1, 1.0, 10.0]}, factor=2, folds=3)
    assert hist.count() >= 4


def test_singular_and_constant(spark):
    same = spark.createDataFrame([(i, [1.0, float(i), 2.0 * i], float(i % 3)) for i in range(30)], "row_id long, vector array<double>, y double")
    assert all(r.r2 is not None for r in M.cross_validate(same, "linear_regression", folds=3).collect())
    flat = same.selectExpr("row_id", "vector", "7.0D as y")
    assert [r.r2 for r in M.cross_validate(flat, "ridge", folds=3).collect()] == [None] * 3
    assert [r.r2 for r in M.cross_validate(same.limit(0), "ridge", folds=2).collect()] == [None] * 2


def test_bootstrap_draws(spark, data, monkeypatch):
    a = {r.draw: (r.row_id, r.y) for r in M.bootstrap(data, 1000, 5.0, seed=3).collect()}
    assert sorted(a) == list(range(1000)) and len({i for i, _ in a.values()}) > 200
    monkeypatch.setattr(M, "BUCKET_ROWS", 4)  # 128 buckets, other tasks: the same draws
    b = {r.draw: (r.row_id, r.y) for r in M.bootstrap(data.repartition(7), 1000, 5.0, seed=3).collect()}
    assert a == b
    plan = M.bootstrap(data, 10)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert M.bootstrap(data.drop("row_id"), 50).columns == ["draw", "vector", "y"]
    with pytest.raises(ValueError):
        M.bootstrap(data.limit(0), 5)
