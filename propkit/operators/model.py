"""Regression modelling (M1–M16, M19) on Spark ML.

* M1 prep: vectors ⋈ targets on ``row_id`` → parse y → drop null y / zero-component
  vectors → transform → scale (fitted on all rows by default, as the reference;
  ``fit_on='train'`` fits on the training split only).
* M2/M3 bootstrap: exactly ``n`` draws with replacement, first a bucket of rows, then a
  row in it (both from the md5 of the draw), proportional Gaussian noise on y.
* M4 split: rows ordered by ``md5(seed:row_id)``; the first ``ceil(n·f)`` are test.
* M5–M9 models by name; M11–M14 searches; M15 K-fold CV; M16 evaluation with
  inverse scaling then inverse transform; M19 batch scoring.
"""

from __future__ import annotations

import itertools
import json
import warnings
import math
import random
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propkit.functions import transforms as TR
from propkit.functions.parse import parse_number_or_range
from propkit.operators import clean
from propkit.operators.evaluate import regression_metrics, with_linear_fit
from propkit.operators.linear import LINEAR_MODELS, fold_of, fold_scores
from propkit.operators.order_stats import order_statistics
from propkit.operators.power import PowerFit, fit_power
from propkit.operators.rowid import with_row_index
from propkit.operators.scalers import FittedScaler, fit_scaler
from propkit.session import cut_lineage


# ---- M1: training set --------------------------------------------------------------

@dataclass
class TargetPrep:
    transform: str | None = None
    power: PowerFit | None = None
    scaler: FittedScaler | None = None

    def forward(self, col):
        c = F.col(col) if isinstance(col, str) else col
        if self.power is not None:
            c = self.power.transform(c)
        elif self.transform:
            c = TR.forward(c, self.transform)
        if self.scaler is not None:
            c = self.scaler.transform(c)
        return c

    def inverse(self, col, unscale: bool = True, untransform: bool = True):
        c = F.col(col) if isinstance(col, str) else col
        if unscale and self.scaler is not None:
            c = self.scaler.inverse(c)
        if untransform:
            if self.power is not None:
                c = self.power.inverse(c)
            elif self.transform:
                c = TR.inverse(c, self.transform)
        return c

    def to_json(self) -> str:
        return json.dumps({"transform": self.transform, "power": self.power.to_dict() if self.power else None,
                           "scaler": json.loads(self.scaler.to_json()) if self.scaler else None})

    @staticmethod
    def from_json(text: str) -> "TargetPrep":
        d = json.loads(text)
        return TargetPrep(d["transform"], PowerFit(**d["power"]) if d["power"] else None,
                          FittedScaler(d["scaler"]["method"], d["scaler"]["params"]) if d["scaler"] else None)


def training_set(vectors: DataFrame, targets: DataFrame, y_col: str, id_col: str = "row_id",
                 vec_col: str = "vector", skip_invalid_y: bool = True) -> DataFrame:
    """Align vectors and targets (J2), parse y (P3), drop null y (P5) and zero vectors.

    Returns (row_id, vector ARRAY<DOUBLE>, y).
    """
    t = targets.select(F.col(id_col).alias("row_id"), F.col(y_col).alias("_y_raw"))
    if not skip_invalid_y:
        bad = t.where(F.col("_y_raw").isNotNull() & parse_number_or_range("_y_raw").isNull()).limit(1).collect()
        if bad:
            raise ValueError(f"invalid target value {bad[0]['_y_raw']!r}")
    v = vectors.select(F.col(id_col).alias("row_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    j = v.join(t, "row_id", "inner").withColumn("y", parse_number_or_range("_y_raw")).drop("_y_raw")
    return clean.drop_zero_vectors(clean.drop_null_target(j, "y"), "vector")


def fit_target_prep(df: DataFrame, y_col: str = "y", transform: str | None = None,
                    scaling: str | None = "StandardScaler") -> TargetPrep:
    prep = TargetPrep()
    if transform in ("boxcox", "yeo_johnson"):
        prep.power = fit_power(df, y_col, transform)
    elif transform:
        prep.transform = transform
    if scaling:
        tmp = df.select(prep.forward(y_col).alias("_t"))
        prep.scaler = fit_scaler(tmp, "_t", scaling)
    return prep


# ---- M2/M3/M4 ----------------------------------------------------------------------

def _uniform(seed: int, what: str, draw) -> Column:
    """A number in (0, 1) from md5 of (seed, purpose, draw): the same on every cluster."""
    h = F.md5(F.concat(F.lit(f"{seed}:{what}:"), draw.cast("string")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0 ** 52)


BUCKET_ROWS, BUCKET_BITS = 65536, 20


def _numbered(df: DataFrame, key: Column, id_col: str, n: int) -> tuple[DataFrame, np.ndarray, int]:
    """Rows with ``_b``, the first bits of the md5 in ``key``, and ``_o``, their place in that bucket;
    the rows below each bucket; and the number of bits."""
    bits = min(BUCKET_BITS, max(0, math.ceil(math.log2(max(n, 1) / BUCKET_ROWS))))
    bucket = F.shiftright(F.conv(F.substring(key, 1, 5), 16, 10).cast("int"), 20 - bits)
    x = df.withColumn("_h", key).withColumn("_b", bucket)
    sizes = np.zeros(1 << bits, np.int64)
    for r in x.groupBy("_b").count().collect():
        sizes[r["_b"]] = r["count"]
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col)) - 1
    return x.withColumn("_o", place.cast("long")).drop("_h"), np.cumsum(sizes) - sizes, bits


def bootstrap(df: DataFrame, n_samples: int, noise_percentage: float = 0.0, seed: int = 42,
              y_col: str = "y", id_col: str = "row_id") -> DataFrame:
    """Exactly ``n_samples`` rows drawn with replacement, plus y·N(0, pct/100) noise.

    Rows stand in the order of ``(md5(id), id)`` (scan order's number if ``id_col`` is absent), of
    which the first bits are their bucket.  A draw is a number below the row count, from the
    seed and the draw's own number alone: the buckets' sizes turn it into a bucket and a
    place there, so draws fall on buckets by a multinomial of their sizes and rows are
    numbered bucket by bucket, without an order over all of them."""
    spark = df.sparkSession
    own = id_col if id_col in df.columns else "_id"
    rows = df.drop("_b", "_o", "_h")
    rows = rows if own == id_col else with_row_index(rows, own)
    n = rows.count()
    if not n:
        raise ValueError("bootstrap: no rows to draw from")
    numbered, below, _ = _numbered(rows, F.md5(F.col(own).cast("string")), own, n)
    draw = F.col("draw")
    draws = spark.range(n_samples).select(F.col("id").alias("draw"))
    draws = draws.withColumn("_x", F.least(F.floor(_uniform(seed, "row", draw) * n), F.lit(n - 1)).cast("long"))

    def placed(batches):
        for batch in batches:
            x = batch.column(1).to_numpy()
            b = np.searchsorted(below, x, side="right") - 1  # the last bucket that begins here is not empty
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(b.astype(np.int32)), pa.array(x - below[b])], names=["draw", "_b", "_o"])
    draws = draws.mapInArrow(placed, "draw long, _b int, _o long")
    if noise_percentage:  # Box-Muller
        radius = F.sqrt(-2.0 * F.ln(_uniform(seed, "radius", draw)))
        draws = draws.withColumn("_noise", radius * F.cos(2.0 * math.pi * _uniform(seed, "angle", draw)))
    out = draws.join(numbered, ["_b", "_o"], "inner").drop("_b", "_o")
    out = out if own == id_col else out.drop(own)
    if noise_percentage:
        out = out.withColumn(y_col, F.col(y_col) + F.col("_noise") * (noise_percentage / 100.0) * F.abs(F.col(y_col)))
    return out.drop("_noise")


def split_train_test(df: DataFrame, test_size: float, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Adds ``split`` ('train'/'test'); ``test_size = 0`` → all rows are both (two copies).

    Exactly ``ceil(n·f)`` test rows in the order of ``(md5(seed:row_id), row_id)``: the cut is
    found by selection over the first 60 bits of the hashes, and every row is labelled by
    comparing its own pair with it.  Rows are neither sorted nor moved.
    """
    if test_size <= 0:
        return df.withColumn("split", F.lit("train")).unionByName(df.withColumn("split", F.lit("test")))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    pairs = df.select(h.alias("_h"), F.col(id_col).alias("_i"), F.conv(F.substring(h, 1, 15), 16, 10).cast("long").alias("_k"))
    n = df.count()
    n_test = math.ceil(test_size * n)
    if n_test >= n:
        return df.withColumn("split", F.lit("test"))
    key, below = order_statistics(pairs.select("_k"), [n_test - 1])[n_test - 1]
    # the ids whose hashes share these 60 bits: one, but for chance
    for cut in pairs.where(F.col("_k") == key).groupBy("_h", "_i").count().orderBy("_h", "_i").collect():
        below += cut["count"]
        if below >= n_test:
            break
    is_test = (h < F.lit(cut["_h"])) | ((h == F.lit(cut["_h"])) & (F.col(id_col) <= F.lit(cut["_i"])))
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


# ---- M5–M9: models by name --------------------------------------------------------

MODEL_NAMES = ("linear_regression", "ridge", "knn", "rfr", "gbr", "xgboost", "catboost", "lgbm")


_KNOWN_PARAMS = {
    "linear_regression": {"fit_intercept", "n_jobs"},
    "ridge": {"alpha", "fit_intercept"},
    "rfr": {"random_state", "n_estimators", "max_depth", "max_features", "min_samples_leaf", "n_jobs"},
    "gbr": {"random_state", "n_estimators", "iterations", "max_depth", "depth", "learning_rate", "subsample", "n_jobs"},
    "knn": {"n_neighbors", "n_jobs"},
}


SPARK_MAX_DEPTH = 30  # an unset depth means "until leaves are pure"; Spark's trees end here


def _feature_subset(value) -> str:
    """Features tried per split: all unless told otherwise (a count, a fraction, ``sqrt``, ``log2``)."""
    return "all" if value is None or value == 1.0 and isinstance(value, float) else str(value)


def make_estimator(name: str, params: dict | None = None, n_rows: int | None = None, y_std_pop: float | None = None,
                   features: str = "features", label: str = "y", seed: int = 42):
    p = dict(params or {})
    known = _KNOWN_PARAMS.get("gbr" if name in ("xgboost", "catboost", "lgbm") else name, set())
    unmapped = sorted(set(p) - known)
    if unmapped and name in MODEL_NAMES:
        warnings.warn(f"{name}: parameters without a Spark ML equivalent are ignored: {unmapped}")
    if name == "linear_regression":
        return LinearRegression(featuresCol=features, labelCol=label, regParam=0.0, solver="normal",
                                fitIntercept=p.get("fit_intercept", True))
    if name == "ridge":
        alpha = float(p.get("alpha", 1.0))
        reg = alpha * (y_std_pop or 1.0) / (n_rows or 1)
        return LinearRegression(featuresCol=features, labelCol=label, regParam=reg, elasticNetParam=0.0,
                                standardization=False, solver="normal", fitIntercept=p.get("fit_intercept", True))
    if name == "rfr":
        return RandomForestRegressor(featuresCol=features, labelCol=label, seed=int(p.get("random_state", seed)),
                                     numTrees=int(p.get("n_estimators", 100)),
                                     maxDepth=int(p.get("max_depth") or SPARK_MAX_DEPTH),
                                     featureSubsetStrategy=_feature_subset(p.get("max_features")),
                                     minInstancesPerNode=int(p.get("min_samples_leaf", 1)))
    if name in ("gbr", "xgboost", "catboost", "lgbm"):
        return GBTRegressor(featuresCol=features, labelCol=label, seed=int(p.get("random_state", seed)),
                            maxIter=int(p.get("n_estimators", p.get("iterations", 100))),
                            maxDepth=int(p.get("max_depth", p.get("depth", 3)) or 3),
                            stepSize=float(p.get("learning_rate", 0.1)),
                            subsamplingRate=float(p.get("subsample", 1.0)))
    if name == "knn":
        return KNNRegressor(k=int(p.get("n_neighbors", 5)))
    raise ValueError(f"model {name!r} is not built; choose one of {MODEL_NAMES}")


class KNNRegressor:
    """Estimator-shaped wrapper around :func:`propkit.operators.neighbors.knn_regress`."""

    def __init__(self, k: int = 5):
        self.k = k
        self.train = None

    def fit(self, df: DataFrame):
        self.train = df.select("row_id", "vector", "y")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        from propkit.operators.neighbors import knn_regress
        # a row may stand in both splits: each id is asked once
        asked = df.select("row_id", "vector").dropDuplicates(["row_id"])
        pred = cut_lineage(knn_regress(self.train, asked, k=self.k)).withColumnRenamed("y_pred", "prediction")  # one search for all uses
        return df.join(pred, "row_id", "inner")


def _with_features(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col("vector")))


# ---- M16: fit + evaluate ------------------------------------------------------------

@dataclass
class TrainResult:
    model: object
    prep: TargetPrep
    predictions: DataFrame  # split, row_id, y_true, y_pred, y_linear_fit
    metrics: DataFrame      # per split
    extras: dict = field(default_factory=dict)


def _fit(model: str, params: dict | None, train: DataFrame, label: str, seed: int):
    """One fit; ridge's α is scaled by the rows it is fitted on."""
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("s")).first()
    est = make_estimator(model, params, stats["n"], stats["s"], label=label, seed=seed)
    return est.fit(train.select("row_id", "vector", F.col(label).alias("y")) if isinstance(est, KNNRegressor) else train)


def train_and_evaluate(data: DataFrame, model: str = "linear_regression", params: dict | None = None,
                       test_size: float = 0.2, transform: str | None = None,
                       scaling: str | None = "StandardScaler", seed: int = 42, inverse_scaling: bool = True,
                       inverse_transform: bool = True, fit_on: str = "all", tune: dict | None = None) -> TrainResult:
    """M1 → M4 → fit → M16 evaluation on both splits (inverse scale, then inverse transform).

    ``tune`` holds the arguments of :func:`search_scores` (``grid``, ``method``, …): the
    candidates are compared on the training split and the prepared target, on top of
    ``params``, and the best one is fitted on the whole training split."""
    split = split_train_test(data, test_size, seed).persist()
    one_copy = split.where(F.col("split") == "train") if fit_on == "train" or test_size <= 0 else split
    prep = fit_target_prep(one_copy, "y", transform, scaling)
    prepared = _with_features(split.withColumn("y_t", prep.forward("y")))
    train = prepared.where(F.col("split") == "train")
    extras = {"params": dict(params or {})}
    if tune:
        best, extras["search_results"] = search_scores(train, model, params=params, label="y_t", seed=seed, **tune)
        extras["params"] |= best
        extras["best_params"] = best
    fitted = _fit(model, extras["params"], train, "y_t", seed)
    scored = fitted.transform(prepared)
    inv = lambda c: prep.inverse(c, inverse_scaling, inverse_transform)
    pred = scored.select("split", "row_id", inv("y_t").alias("y_true"), inv("prediction").alias("y_pred"))
    pred = with_linear_fit(pred, "y_true", "y_pred", by=["split"])
    metrics = regression_metrics(pred, "y_true", "y_pred", by=["split"])
    return TrainResult(fitted, prep, pred, metrics, extras)


# ---- M15 ------------------------------------------------------------------------

def cross_validate(data: DataFrame, model: str = "linear_regression", params: dict | None = None, folds: int = 5,
                   seed: int = 42) -> DataFrame:
    """K-fold R² on raw y (the reference cross-validates after undoing its y
    transforms).  Folds by hash of (seed, row_id); returns (fold, r2)."""
    schema = "fold int, r2 double"
    if model in LINEAR_MODELS:
        scores = fold_scores(data, fold_of(seed, folds), folds, [params or {}], model)[0]
        return data.sparkSession.createDataFrame(list(enumerate(scores)), schema)
    d = _with_features(data.withColumn("fold", fold_of(seed, folds))).persist()
    rows = []
    for f in range(folds):
        tr, te = d.where(F.col("fold") != f), d.where(F.col("fold") == f)
        m = regression_metrics(_fit(model, params, tr, "y", seed).transform(te), "y", "prediction").first()
        rows.append((f, m["r2"]))
    d.unpersist()
    return data.sparkSession.createDataFrame(rows, schema)


def cv_summary(scores: DataFrame) -> DataFrame:
    """M15's summary: mean R² and twice its standard deviation over the folds (one row)."""
    return scores.agg(F.avg("r2").alias("cv_mean"), (2 * F.stddev_pop("r2")).alias("cv_two_std"), F.count("r2").alias("folds"))


# ---- M11–M14 ------------------------------------------------------------------------

def _candidates(model: str, grid: dict, pick: int | None, seed: int) -> list[dict]:
    known = _KNOWN_PARAMS.get("gbr" if model in ("xgboost", "catboost", "lgbm") else model, set())
    for k in grid:
        if k not in known:
            raise ValueError(f"parameter {k!r} has no Spark equivalent for {model}")
    found = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return random.Random(seed).sample(found, pick) if pick is not None and pick < len(found) else found


def _cv_scores(data: DataFrame, model: str, candidates: list[dict], folds: int, seed: int, parallelism: int,
               params: dict | None, label: str, fraction: float = 1.0) -> list[list[float]]:
    """R² of every candidate on every hashed fold: linear models from one aggregate, the fits of
    a fold of others side by side."""
    d = data
    if fraction < 1.0:
        d = d.where(fold_of(seed + 7, 1000000) < int(fraction * 1000000))
    if model in LINEAR_MODELS:
        found = fold_scores(d, fold_of(seed, folds), folds, [{**(params or {}), **c} for c in candidates], model, label)
        return [[-math.inf if r is None else r for r in row] for row in found]
    d = _with_features(d).withColumn("fold", fold_of(seed, folds)).persist()
    scores: list[list[float]] = [[] for _ in candidates]
    for f in range(folds):
        tr, te = d.where(F.col("fold") != f), d.where(F.col("fold") == f)

        def one(c: dict) -> float:
            fitted = _fit(model, {**(params or {}), **c}, tr, label, seed)
            r2 = regression_metrics(fitted.transform(te), label, "prediction").first()["r2"]
            return -math.inf if r2 is None else float(r2)

        with ThreadPool(parallelism) as pool:
            for i, r2 in enumerate(pool.map(one, candidates)):
                scores[i].append(r2)
    d.unpersist()
    return scores


def _results_frame(spark, candidates: list[dict], scores: list[list[float]]) -> DataFrame:
    rows = [(i, json.dumps(c), float(np.mean(s)), float(np.std(s))) for i, (c, s) in enumerate(zip(candidates, scores))]
    res = spark.createDataFrame(rows, "candidate int, params string, mean_test_score double, std_test_score double")
    return res.withColumn("rank_test_score", F.rank().over(Window.orderBy(F.desc("mean_test_score"))))  # W3: tiny


def grid_scores(data: DataFrame, model: str, grid: dict, folds: int = 5, seed: int = 42, n_iter: int | None = None,
                parallelism: int = 4, sample_fraction: float = 1.0, params: dict | None = None,
                label: str = "y") -> tuple[dict, DataFrame]:
    """M11 (all candidates) / M12 (``n_iter`` seeded candidates): (best candidate, results DF:
    candidate, params, mean_test_score, std_test_score, rank_test_score)."""
    candidates = _candidates(model, grid, n_iter, seed)
    scores = _cv_scores(data, model, candidates, folds, seed, parallelism, params, label, sample_fraction)
    best = max(range(len(candidates)), key=lambda i: (np.mean(scores[i]), -i))
    return candidates[best], _results_frame(data.sparkSession, candidates, scores)


def halving_scores(data: DataFrame, model: str, grid: dict, factor: int = 3, folds: int = 5, seed: int = 42,
                   n_candidates: int | None = None, parallelism: int = 4, params: dict | None = None,
                   label: str = "y") -> tuple[dict, DataFrame]:
    """Successive halving — every round scores all surviving candidates in one
    cross-validation on a hashed sample, keeps the top 1/factor, grows the sample ×factor."""
    left = _candidates(model, grid, n_candidates, seed)
    rounds = max(1, math.ceil(math.log(max(len(left), 1), factor)))
    frac = 1.0 / factor ** (rounds - 1)
    history = []
    it = 0
    while True:
        scores = [float(np.mean(s)) for s in _cv_scores(data, model, left, folds, seed, parallelism, params, label, min(frac, 1.0))]
        order = sorted(range(len(left)), key=lambda i: (-scores[i], i))
        history += [(it, json.dumps(left[i]), min(frac, 1.0), scores[i]) for i in order]
        if len(left) <= 1 or frac >= 1.0:
            break
        left = [left[i] for i in order[:max(1, math.ceil(len(left) / factor))]]
        frac *= factor
        it += 1
    hist = data.sparkSession.createDataFrame(history, "iteration int, params string, fraction double, "
                                                      "mean_test_score double")
    return left[order[0]], hist


def grid_search(data: DataFrame, model: str, grid: dict, folds: int = 5, seed: int = 42, params: dict | None = None,
                label: str = "y", **how):
    """:func:`grid_scores`, and the best candidate fitted on all of ``data``: (model, results)."""
    best, table = grid_scores(data, model, grid, folds, seed, params=params, label=label, **how)
    return _fit(model, {**(params or {}), **best}, _with_features(data), label, seed), table


def halving_search(data: DataFrame, model: str, grid: dict, factor: int = 3, folds: int = 5, seed: int = 42,
                   params: dict | None = None, label: str = "y", **how):
    """:func:`halving_scores`, and the best candidate fitted on all of ``data``: (model, history)."""
    best, table = halving_scores(data, model, grid, factor, folds, seed, params=params, label=label, **how)
    return _fit(model, {**(params or {}), **best}, _with_features(data), label, seed), table


SEARCH_METHODS = ("GridSearchCV", "RandomizedSearchCV", "HalvingGridSearchCV", "HalvingRandomSearchCV",
                  "DaskGridSearchCV", "DaskRandomizedSearchCV")


def search_scores(data: DataFrame, model: str, grid: dict, method: str = "GridSearchCV", folds: int = 5, seed: int = 42,
                  n_iter: int | None = None, factor: int = 3, params: dict | None = None,
                  label: str = "y") -> tuple[dict, DataFrame]:
    """(best candidate, results) by the reference's method names; the Dask variants run the same search."""
    how = {"folds": folds, "seed": seed, "params": params, "label": label}
    if method in ("GridSearchCV", "DaskGridSearchCV"):
        return grid_scores(data, model, grid, **how)
    if method in ("RandomizedSearchCV", "DaskRandomizedSearchCV"):
        return grid_scores(data, model, grid, n_iter=n_iter or 10, **how)
    if method == "HalvingGridSearchCV":
        return halving_scores(data, model, grid, factor, **how)
    if method == "HalvingRandomSearchCV":
        return halving_scores(data, model, grid, factor, n_candidates=n_iter, **how)
    raise ValueError(f"unknown search method {method!r}; choose one of {SEARCH_METHODS}")


def search(data: DataFrame, model: str, grid: dict, method: str = "GridSearchCV", folds: int = 5, seed: int = 42,
           n_iter: int | None = None, factor: int = 3, params: dict | None = None, label: str = "y"):
    """:func:`search_scores` with the best candidate fitted on all of ``data``: (model, results)."""
    best, table = search_scores(data, model, grid, method, folds, seed, n_iter, factor, params, label)
    return _fit(model, {**(params or {}), **best}, _with_features(data), label, seed), table


# ---- M19 ------------------------------------------------------------------------

def score(model, prep: TargetPrep, vectors: DataFrame, invert_transform: bool = True) -> DataFrame:
    """Batch scoring: features → model → inverse scaling (and transform) → predicted_value."""
    d = _with_features(vectors.withColumn("vector", F.col("vector").cast("array<double>")))
    out = model.transform(d)
    return out.withColumn("predicted_value", prep.inverse("prediction", True, invert_transform)).drop(
        "features", "prediction")


def predict_from_strings(embedder, model, prep: TargetPrep, df: DataFrame, col: str, pca_pipeline=None,
                         invert_transform: bool = True, id_col: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """M19 end to end: string column → embedding (E8, or E10 through a fitted PCA
    pipeline) → model → ``predicted_value`` (unscaled, and untransformed unless
    ``invert_transform=False``).  Returns (predictions, invalid input rows)."""
    from propkit.operators.embed import embed_then_pca
    v = embed_then_pca(embedder, pca_pipeline, df, col) if pca_pipeline is not None else embedder(df, col)
    valid = v.where(F.col("is_valid"))
    pred = score(model, prep, valid.withColumnRenamed(id_col, "row_id"), invert_transform)
    return pred.withColumnRenamed("row_id", id_col), v.where(~F.col("is_valid")).select(id_col, col)


def save_trained(result: TrainResult, path: str) -> str:
    """The model (a PipelineModel; for knn its training rows and k), the target-prep
    sidecar and the record of the parameters it was trained with."""
    from propkit.sources.sinks import write_sidecar
    m, spark = result.model, result.predictions.sparkSession
    prep = json.loads(result.prep.to_json())
    if isinstance(m, KNNRegressor):
        m.train.write.mode("overwrite").parquet(f"{path}/model")
        prep["knn"] = m.k
    else:
        pm = m if isinstance(m, PipelineModel) else PipelineModel(stages=[m])
        pm.write().overwrite().save(f"{path}/model")
    write_sidecar(spark, f"{path}/target_prep", prep)
    write_sidecar(spark, f"{path}/parameters", result.extras.get("params", {}))
    return path


def load_trained(spark, path: str):
    from propkit.sources.sinks import read_sidecar
    record = read_sidecar(spark, f"{path}/target_prep")
    prep = TargetPrep.from_json(json.dumps(record))
    if "knn" in record:
        return KNNRegressor(record["knn"]).fit(spark.read.parquet(f"{path}/model")), prep
    return PipelineModel.load(f"{path}/model"), prep


__all__ = ["training_set", "fit_target_prep", "bootstrap", "split_train_test", "make_estimator", "train_and_evaluate",
           "cross_validate", "grid_search", "halving_search", "score", "save_trained", "load_trained", "Pipeline"]
