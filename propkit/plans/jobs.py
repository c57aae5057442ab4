"""Job-level plans: the reference's batch jobs as Spark pipelines.

Each job reads a table, runs operators lazily, and writes its outputs once.  A job
that re-reads a derived table (the profile) writes it first, as the reference does
with its analysis file, so expensive per-row expressions run a single time and the
later stages start from a stored table (which also cuts lineage for recovery).
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propkit.operators import clean, evaluate, profile, stats
from propkit.operators.power import auto_transform, fit_power, transform_scores_frame
from propkit.operators.rowid import with_row_index
from propkit.sources.readers import read_table
from propkit.sources.sinks import read_sidecar, write_sidecar, write_table


def distribution_report(df: DataFrame, col: str, auto: bool = False, transform: str | None = None) -> dict:
    """Distribution-analysis job: optional (auto) transform, then describe, histogram,
    box plot, Q-Q, Anderson-Darling, skewness/kurtosis and KDE — as DataFrames.

    One cached ranking serves the quantiles, Q-Q points and A²."""
    from propkit.functions import transforms as TR
    out = {"applied_transformation": None, "boxcox_lambda": None}
    y = stats.values(df, col)
    if auto:
        choice = auto_transform(df, col)
        out["candidates"] = transform_scores_frame(df, choice)
        m = choice.best
        if m in choice.fits:
            y = y.select(choice.fits[m].transform("y").alias("y"))
        elif m and m != "original":
            y = y.select(TR.forward("y", m).alias("y"))
        out["applied_transformation"] = m
        if "boxcox" in choice.fits:
            out["boxcox_lambda"] = choice.fits["boxcox"].lam
    elif transform:
        if transform in ("boxcox", "yeo_johnson"):
            fit = fit_power(df, col, transform)
            y = y.select(fit.transform("y").alias("y"))
            out["boxcox_lambda"] = fit.lam if transform == "boxcox" else None
        else:
            y = y.select(TR.forward("y", transform).alias("y"))
        out["applied_transformation"] = transform
    y = stats.values(y, "y").persist()
    mo = stats.moments(y)
    ranked = stats.Ranked(y, mo.n)
    q1, q2, q3 = ranked.quantiles([0.25, 0.5, 0.75])
    spark = df.sparkSession
    out["descriptive_statistics"] = spark.createDataFrame(
        [(mo.n, mo.mean, mo.std, mo.min, q1, q2, q3, mo.max)],
        "count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
    out["box_plot"] = {"min": mo.min, "q1": q1, "median": q2, "q3": q3, "max": mo.max}
    out["histogram"] = stats.histogram(y, "y")
    out["qq_plot"] = stats.qq_points(y, "y", ranked)
    # a constant (or single-value) sample has no defined statistic
    stat = stats.anderson_darling_statistic(ranked.distinct, mo.n, mo.mean, mo.std).first()["statistic"] if mo.std else None
    out["anderson_darling_test"] = {"statistic": stat, "significance_levels": stats.AD_SIGNIFICANCE,
                                    "critical_values": stats.ad_critical_values(mo.n)}
    out["skewness"], out["kurtosis"] = mo.skew_unbiased, mo.kurt_unbiased
    out["kde"] = stats.kde(y, "y")
    out["_release"] = y.unpersist
    return out


def filter_target_job(spark: SparkSession, path: str, col: str, lo=None, hi=None, out: str | None = None) -> DataFrame:
    """Target range filter job (P4 + P7) with an optional CSV/parquet sink."""
    df = clean.range_filter(read_table(spark, path, normalize=False), col, lo, hi)
    if out:
        write_table(df, out)
    return df


def dedup_job(df: DataFrame, col: str, out_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Duplicate check job: index rows (scan order) if needed, split kept/dropped."""
    # an existing row_id need not be in order: the first row is told by the scan order
    kept, dropped = clean.dedup_lower(with_row_index(df, "row_id"), col, None)
    if out_dir:
        write_table(kept, f"{out_dir}/deduplicated")
        write_table(dropped, f"{out_dir}/duplicates")
    return kept, dropped


def profile_job(spark: SparkSession, df: DataFrame, col: str, out_dir: str, bin_size: int = 10,
                id_col: str = "row_id", csv_copy: bool = False) -> dict:
    """Structure-analysis job: profile once → write (valid + invalid rows) → distributions.

    ``csv_copy`` also writes the profile as CSV with the two maps as JSON text (P13)."""
    prof = profile.structure_profile(with_row_index(df, id_col), col)
    write_table(prof, f"{out_dir}/profile")
    stored = spark.read.parquet(f"{out_dir}/profile")
    write_table(stored.where(~F.col("is_valid")), f"{out_dir}/invalid")
    if csv_copy:
        write_table(profile.profile_json(stored), f"{out_dir}/profile_csv", fmt="csv")
    res = distributions_from_profile(spark, f"{out_dir}/profile", "all", bin_size)
    res["top_elements"] = profile.top_elements(stored)
    res["element_categories"] = profile.element_category_totals(stored)
    res["summary"] = profile.profile_summary(stored)
    write_sidecar(spark, f"{out_dir}/metadata", {"column": col, "index_column": id_col, "bin_size": bin_size})
    return res


MODES = ("all", "size_distribution", "structural_distribution", "elemental_distribution")


def distributions_from_profile(spark: SparkSession, path: str, mode: str = "all", bin_size: int = 10,
                               fmt: str = "parquet") -> dict:
    """E5: distributions from a saved profile (parquet, or CSV with JSON map columns)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if fmt == "csv":
        stored = profile.profile_from_json(read_table(spark, path, "csv", normalize=False))
    else:
        stored = spark.read.parquet(path)
    res = {}
    if mode in ("all", "size_distribution"):
        res["size_distribution"] = profile.size_counts(stored)
        res["binned_size_distribution"] = profile.binned_size_distribution(stored, bin_size)
    if mode in ("all", "structural_distribution"):
        res["structural_distribution"] = profile.structural_distribution(stored)
    if mode in ("all", "elemental_distribution"):
        res["elemental_distribution"] = profile.elemental_distribution(stored)
    return res


def make_index_job(spark: SparkSession, path: str, index_column: str, out: str, filetype: str | None = None,
                   fmt: str = "parquet") -> DataFrame:
    """S8 as a job: use ``index_column`` if the table has it, else number rows 0..n-1
    in scan order under that name; written to ``out`` (never over the input)."""
    df = with_row_index(read_table(spark, path, filetype, normalize=False), index_column)
    cols = [index_column] + [c for c in df.columns if c != index_column]
    write_table(df.select(*cols), out, fmt=fmt)
    return spark.read.parquet(out) if fmt == "parquet" else read_table(spark, out, fmt)


def profile_filter_job(spark: SparkSession, training: DataFrame, out_dir: str, id_col: str | None = None,
                       out: str | None = None, **filters) -> DataFrame:
    """Filter job on a stored profile, semi-joined back to the training table.

    The profile's metadata says which column indexes it; without metadata the folder is no
    finished profile and the job stops.  ``out`` gets the filtered profile and the filtered
    training table side by side, with a record of the filters."""
    record = read_sidecar(spark, f"{out_dir}/metadata")
    if "index_column" not in record:
        raise ValueError(f"{out_dir}/metadata names no index column")
    own = record["index_column"]
    id_col = id_col or own
    stored = spark.read.parquet(f"{out_dir}/profile")
    kept = profile.filter_profile(stored, **filters)
    rows = profile.semi_join_rows(training, kept.withColumnRenamed(own, id_col), id_col)
    if out:
        write_table(kept, f"{out}/profile")
        write_table(rows, f"{out}/training")
        write_sidecar(spark, f"{out}/metadata", {**record, "index_column": own, "training_index_column": id_col, "filters": filters})
    return rows


def prediction_analysis_job(df: DataFrame, column_x: str, column_y: str) -> tuple[DataFrame, DataFrame]:
    """Metrics row + per-row fitted line."""
    return (evaluate.prediction_analysis(df, column_x, column_y),
            evaluate.with_linear_fit(df, column_x, column_y))


SUMMARY = ("model string, parameters string, input_rows long, n_features int, n_rows long, train_rows long, test_rows long, "
           "train_mean double, train_std double, train_min double, train_max double, "
           "test_mean double, test_std double, test_min double, test_max double, train_r2 double, test_r2 double, "
           "bootstrap boolean, bootstrap_arguments string, best_score double, seconds double")


def run_summary(vectors: DataFrame, data: DataFrame, res, model: str, params: dict, bootstrap: dict, best: float | None,
                seconds: float) -> DataFrame:
    """One row on a training run: shapes, the target of both splits, arguments, scores, time."""
    y = F.col("y_true")
    per = {r["split"]: r for r in res.predictions.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max")).collect()}
    r2 = {r["split"]: r["r2"] for r in res.metrics.select("split", "r2").collect()}
    stats = [per[k][c] if k in per else None for k in ("train", "test") for c in ("mean", "std", "min", "max")]
    one = data.select(F.size("vector")).first()
    row = (model, json.dumps(params, default=str), vectors.count(), one[0] if one else None, data.count(),
           *[per[k]["n"] if k in per else 0 for k in ("train", "test")], *stats, r2.get("train"), r2.get("test"),
           bool(bootstrap), json.dumps(bootstrap), None if best is None else float(best), float(seconds))
    return data.sparkSession.createDataFrame([row], SUMMARY)


def train_job(vectors: DataFrame, targets: DataFrame, y_col: str, model: str = "linear_regression",
              parameters: dict | None = None, test_size: float = 0.2, bootstrap: bool = False,
              bootstrap_nsamples: int = 0, noise_percentage: float = 0.0, ytransformation: str | None = None,
              yscaling: str | None = "StandardScaler", skip_invalid_y_values: bool = True,
              fine_tune_model: bool = False, grid_search_method: str = "GridSearchCV",
              fine_tuned_hyperparameters: dict | None = None, grid_search_parameters: dict | None = None,
              cv_fold: int = 5, cross_validation: bool = False, inverse_scaling: bool = True,
              inverse_transform: bool = True, save_to: str | None = None, seed: int = 42, lineage: dict | None = None) -> dict:
    """Training job with the reference's run arguments (M1 → M2/M3 → M4 → fit or search
    → M16 → M15 → S11/S12).  Returns DataFrames, among them ``summary``, one row on the run.

    ``lineage`` records how the vectors were made, for scoring from the saved model alone:
    ``word2vec`` (folder), ``radius``, ``kind`` and, if any, ``pca`` (folder)."""
    from propkit.operators import model as M
    from propkit.sources.sinks import write_results
    begun = time.monotonic()
    data = M.training_set(vectors, targets, y_col, skip_invalid_y=skip_invalid_y_values)
    if bootstrap:
        # a row drawn twice needs two identities: the draw number is unique and deterministic
        data = M.bootstrap(data, int(bootstrap_nsamples), float(noise_percentage), seed) \
            .drop("row_id").withColumnRenamed("draw", "row_id")
    out = {"bootstrap": bootstrap, "n_rows": data.count()}
    params, tune = dict(parameters or {}), None
    if fine_tune_model:
        gp = grid_search_parameters or {}
        grid = {k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in (fine_tuned_hyperparameters or {}).items()}
        tune = {"grid": grid, "method": grid_search_method, "folds": cv_fold, "n_iter": gp.get("n_iter"),
                "factor": int(gp.get("factor", 3))}
    res = M.train_and_evaluate(data, model, params, test_size, ytransformation, yscaling, seed,
                               inverse_scaling, inverse_transform, tune=tune)
    if tune:
        out["search_results"], out["best_candidate"] = res.extras["search_results"], res.extras["best_params"]
        # the fitted model's own names for what the search may set
        out["best_params"] = {p.name: v for p, v in res.model.extractParamMap().items() if p.name in (
            "regParam", "numTrees", "maxDepth", "maxIter", "stepSize", "minInstancesPerNode")} if hasattr(res.model, "extractParamMap") else {}
        params = res.extras["params"]
    out["predictions"], out["metrics"] = res.predictions, res.metrics
    out["result"] = res
    if cross_validation and not fine_tune_model and test_size > 0:
        out["cv_scores"] = M.cross_validate(data, model, params, cv_fold, seed)
        out["cv_summary"] = M.cv_summary(out["cv_scores"])
    best = None
    if tune:
        best = out["search_results"].agg(F.max("mean_test_score")).first()[0]
    elif "cv_summary" in out:
        best = out["cv_summary"].first()["cv_mean"]
    arguments = {"nsamples": int(bootstrap_nsamples), "noise_percentage": float(noise_percentage)} if bootstrap else {}
    out["summary"] = run_summary(vectors, data, res, model, params, arguments, best, time.monotonic() - begun)
    if save_to:
        M.save_trained(res, f"{save_to}/model")
        if lineage is not None:
            write_sidecar(data.sparkSession, f"{save_to}/model/lineage", lineage)
        write_results(res.predictions, res.metrics, f"{save_to}/results", out["summary"])
        if tune:
            write_table(out["search_results"], f"{save_to}/search_results")
    return out


def vector_reduction_job(spark: SparkSession, vectors: DataFrame, out_dir: str, pca_dim: int = 70,
                         n_clusters: int = 20, compute_kmeans: bool = False, seed: int = 42,
                         vec_col: str = "vector") -> dict:
    """V1–V5 as a job: scaler+PCA pipeline (saved, reusable by E10), scores with
    optional K-means cluster ids, explained-variance table, K-means model."""
    from propkit.operators.vectors import explained_variance, fit_pca_pipeline, kmeans_clusters, pca_scores
    pipe = fit_pca_pipeline(vectors, vec_col, pca_dim)
    pipe.write().overwrite().save(f"{out_dir}/pca_pipeline")
    scores = pca_scores(pipe, vectors, vec_col)
    out = {"pipeline": pipe, "explained_variance": explained_variance(pipe, spark)}
    if compute_kmeans:
        scores, km = kmeans_clusters(scores, n_clusters, seed)
        km.write().overwrite().save(f"{out_dir}/kmeans")
        out["kmeans"] = km
    write_table(scores, f"{out_dir}/scores")
    write_table(out["explained_variance"], f"{out_dir}/explained_variance")
    out["scores"] = spark.read.parquet(f"{out_dir}/scores")
    return out


def word2vec_job(spark: SparkSession, df: DataFrame, col: str, out_dir: str, radius: int = 1,
                 vector_size: int = 300, min_count: int = 1, kind: str = "structure", seed: int = 42):
    """E6 + E7 as a job: corpus written once (whole strings), Word2Vec trained on it, saved."""
    from propkit.operators.embed import corpus, save_word2vec, train_word2vec
    write_table(corpus(df, col, radius, kind).select("sentence"), f"{out_dir}/corpus")
    model = train_word2vec(spark.read.parquet(f"{out_dir}/corpus"), vector_size=vector_size,
                           min_count=min_count, seed=seed)
    save_word2vec(model, f"{out_dir}/word2vec")
    write_sidecar(spark, f"{out_dir}/metadata", {"column": col, "radius": radius, "vector_size": vector_size,
                                                 "min_count": min_count, "kind": kind})
    return model


def embedding_job(spark: SparkSession, df: DataFrame, col: str, embedder, out_dir: str, id_col: str = "row_id") -> dict:
    """E11 as a job: the embedding is written once; vectors of valid rows (S9), the invalid
    rows (P14) and a lineage record are written from it."""
    from propkit.operators.embed import embed_job
    from propkit.sources.sinks import write_vectors
    vectors, _ = embed_job(embedder, with_row_index(df, id_col), col, id_col)
    write_table(vectors, f"{out_dir}/embedded")
    got = spark.read.parquet(f"{out_dir}/embedded")
    write_vectors(got.where("is_valid"), f"{out_dir}/vectors", vec_col="vector")
    write_table(got.where("NOT is_valid").select("row_id", col), f"{out_dir}/invalid")
    counts = clean.validity_counts(got).first().asDict()
    write_sidecar(spark, f"{out_dir}/metadata", {"column": col, "index_column": id_col, **counts})
    return {"embedded": got, "counts": counts}


def saved_embedder(spark: SparkSession, model_dir: str, id_col: str = "row_id"):
    """``(embedder, pca pipeline or None)`` from the lineage saved beside a model."""
    from propkit.operators.embed import load_word2vec, word2vec_embedder
    from propkit.sources.sinks import load_pipeline
    record = read_sidecar(spark, f"{model_dir}/lineage")
    if "word2vec" not in record:
        raise ValueError(f"{model_dir}/lineage names no embedding")
    model = load_word2vec(spark, record["word2vec"])
    embedder = word2vec_embedder(model, int(record.get("radius", 1)), record.get("kind", "structure"), id_col)
    return embedder, load_pipeline(record["pca"]) if record.get("pca") else None


def predict_job(spark: SparkSession, df: DataFrame, col: str, model_dir: str, embedder=None, out: str | None = None,
                pca_pipeline=None, invert_transform: bool = True, id_col: str = "row_id") -> DataFrame:
    """M19 as a job: saved model + target preparation → ``predicted_value`` for every
    valid input row (input columns kept); invalid rows are written beside it.  Without an
    ``embedder`` the one that the model was trained with is found from its lineage."""
    from propkit.operators.model import load_trained, predict_from_strings
    trained_with = read_sidecar(spark, f"{model_dir}/parameters")  # a folder without it holds no finished model
    model, prep = load_trained(spark, model_dir)
    if embedder is None:
        embedder, pca_pipeline = saved_embedder(spark, model_dir, id_col)
    indexed = with_row_index(df, id_col)
    pred, invalid = predict_from_strings(embedder, model, prep, indexed, col, pca_pipeline, invert_transform, id_col)
    res = indexed.join(pred.select(id_col, "predicted_value"), id_col, "inner")
    if out:
        write_table(res, f"{out}/predictions")
        write_table(invalid, f"{out}/invalid")
        write_sidecar(spark, f"{out}/metadata", {"model": model_dir, "column": col, "index_column": id_col, "parameters": trained_with})
    return res
