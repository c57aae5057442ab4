import numpy as np
import pytest
from pyspark.sql import functions as F

from propkit.operators import model as M
from propkit.operators.neighbors import knn_regress
from propkit.operators.vectors import fit_pca_pipeline, pca_scores
from tests.conftest import SF


@pytest.fixture(scope="module")
def vec(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vector"),
                    F.col("label").cast("double").alias("y")).cache()


def test_split_disjoint_exhaustive(vec):
    s = M.split_train_test(vec, 0.2).collect()
    test = [r["row_id"] for r in s if r["split"] == "test"]
    assert len(test) == int(np.ceil(0.2 * len(s)))
    assert len({r["row_id"] for r in s}) == len(s)


def test_bootstrap_exact_n(vec):
    b = M.bootstrap(vec, 777, noise_percentage=1.0, seed=3)
    assert b.count() == 777
    assert b.select("draw").distinct().count() == 777


def test_ridge_matches_closed_form(vec):
    res = M.train_and_evaluate(vec, "ridge", {"alpha": 2.0}, test_size=0.0, scaling=None)
    rows = vec.collect()
    X = np.array([r["vector"] for r in rows])
    y = np.array([r["y"] for r in rows])
    Xc, yc = X - X.mean(0), y - y.mean()
    coef = np.linalg.solve(Xc.T @ Xc + 2.0 * np.eye(X.shape[1]), Xc.T @ yc)
    model = res.model
    assert np.allclose(model.coefficients.toArray(), coef, atol=1e-6)


def test_knn_matches_brute_force(vec):
    rows = vec.collect()
    X = np.array([r["vector"] for r in rows])
    y = np.array([r["y"] for r in rows])
    ids = np.array([r["row_id"] for r in rows])
    q = vec.where(F.col("row_id") % 10 == 0)
    t = vec.where(F.col("row_id") % 10 != 0)
    got = {r["row_id"]: r["y_pred"] for r in knn_regress(t, q, k=5, block_rows=64).collect()}
    tmask = ids % 10 != 0
    for i in np.where(~tmask)[0]:
        d = ((X[tmask] - X[i]) ** 2).sum(1)
        order = np.lexsort((ids[tmask], d))[:5]
        assert got[ids[i]] == pytest.approx(y[tmask][order].mean())


def test_pca_scores_uncorrelated(spark, vec):
    model = fit_pca_pipeline(vec, "vector", 5)
    s = np.array([r["pca"] for r in pca_scores(model, vec, "vector").collect()])
    c = np.corrcoef(s.T)
    assert np.allclose(c - np.diag(np.diag(c)), 0, atol=1e-6)
    assert np.allclose(s.mean(0), 0, atol=1e-6)


def test_ridge_grid_alpha_means_the_same(vec):
    best, res = M.grid_search(vec, "ridge", {"alpha": [2.0]}, folds=3)
    rows = vec.collect()
    X = np.array([r["vector"] for r in rows])
    y = np.array([r["y"] for r in rows])
    Xc, yc = X - X.mean(0), y - y.mean()
    coef = np.linalg.solve(Xc.T @ Xc + 2.0 * np.eye(X.shape[1]), Xc.T @ yc)
    assert np.allclose(best.coefficients.toArray(), coef, atol=1e-6)
    assert res.count() == 1


@pytest.mark.parametrize("folds", [2, 5])
def test_search_uses_folds_and_fixed_parameters(vec, folds):
    best, res = M.grid_search(vec, "rfr", {"max_depth": [1, 3]}, folds=folds, params={"n_estimators": 4})
    assert res.count() == 2 and best.getNumTrees == 4


def test_tuning_refits_the_best_candidate(vec):
    line = vec.withColumn("y", F.col("vector")[0] * 3 + F.col("vector")[1])
    res = M.train_and_evaluate(line, "ridge", {}, tune={"grid": {"alpha": [1e6, 1e-6]}, "folds": 3})
    assert res.extras["params"] == {"alpha": 1e-6}
    assert {r["split"]: r["r2"] for r in res.metrics.collect()}["test"] > 0.999


def test_alpha_means_the_same_in_search_and_cross_validation(vec):
    _, res = M.grid_search(vec, "ridge", {"alpha": [200.0]}, folds=3)
    cv = [r["r2"] for r in M.cross_validate(vec, "ridge", {"alpha": 200.0}, folds=3).collect()]
    assert res.first()["mean_test_score"] == pytest.approx(np.mean(cv), abs=1e-9)


def test_knn_on_both_copies_and_saved(spark, vec, tmp_path):
    res = M.train_and_evaluate(vec, "knn", {"n_neighbors": 1}, test_size=0.0, scaling=None)
    assert res.predictions.where("abs(y_true - y_pred) > 1e-9").count() == 0
    model, prep = M.load_trained(spark, M.save_trained(res, str(tmp_path / "knn")))
    assert M.score(model, prep, vec.drop("y")).count() == vec.count()


def test_bootstrap_does_not_depend_on_the_layout(vec):
    a, b = (M.bootstrap(x, 200, 5.0, seed=9).orderBy("draw").select("draw", "row_id", "y").collect() for x in (vec, vec.repartition(3)))
    assert a == b


def test_pca_keeps_rows_without_a_vector(vec):
    some = vec.withColumn("vector", F.when(F.col("row_id") % 7 > 0, F.col("vector")))
    scores = pca_scores(fit_pca_pipeline(some, "vector", 3), some, "vector")
    assert scores.where("pca is null").count() == some.where("vector is null").count() > 0
    with pytest.raises(ValueError):
        fit_pca_pipeline(some, "vector", 10_000)
