"""Registered queries: each reads the driver tables under ``sf_dir`` and returns a
DataFrame whose column names match the DuckDB oracle (``oracle_sql.py``).

Doubles are rounded to 6 decimals in both engines so that the value hash does not
depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propkit.functions import transforms as TR
from propkit.functions.parse import nan_to_null, parse_number_or_range
from propkit.operators import clean, profile, scalers, stats
from propkit.operators.power import auto_transform, candidate_skews, candidate_methods, fit_power, \
    transform_scores_frame
from propkit.operators.rowid import with_row_index
from propkit.plans.fixtures import STRUCTURES
from propkit.sources.readers import preview, read_table, table_summary

R = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # operators handle NaN themselves (values(), range_filter), so the scan stays a
    # bare parquet read and filters/projections push down into it
    return read_table(spark, f"{sf_dir}/{name}.parquet", normalize=False)


def _round(df: DataFrame, digits: int = R) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---- sources / row identity ------------------------------------------------------

def q_row_count(spark, sf):
    return stats.row_count(table(spark, sf, "events"))


def q_preview_head(spark, sf):
    o = table(spark, sf, "orders").drop("o_orderdate")
    return preview(o, 20, "head", ["o_orderkey"])


def q_preview_tail(spark, sf):
    o = table(spark, sf, "orders").drop("o_orderdate")
    return preview(o, 20, "tail", ["o_orderkey"])


def q_table_summary(spark, sf):
    return table_summary(table(spark, sf, "orders"))


def q_row_index(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return with_row_index(o, "row_id", order_by=["o_custkey", "o_orderkey"])


def q_row_index_payload(spark, sf):
    """S8 with every column carried along and ties in the order key: the index is dense,
    and rows with smaller keys come first."""
    o = with_row_index(table(spark, sf, "orders"), "row_id", order_by=["o_custkey"])
    return o.groupBy("o_custkey").agg(F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"),
                                      F.count_distinct("row_id").alias("n_ids"))


def q_row_index_scan(spark, sf):
    return with_row_index(table(spark, sf, "orders").select("o_orderkey"), "row_id")


# ---- cleaning ------------------------------------------------------------------

def _parts(spark, sf):
    return table(spark, sf, "part").withColumnRenamed("p_partkey", "row_id")


def q_dedup_kept(spark, sf):
    return _round(clean.dedup_lower(_parts(spark, sf), "p_name")[0])


def q_dedup_dropped(spark, sf):
    return _round(clean.dedup_lower(_parts(spark, sf), "p_name")[1])


def q_dedup_documents(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id").select("row_id", "text", "lang")
    kept, _ = clean.dedup_lower(d, "text")
    return kept.select("row_id", "lang", F.length("text").cast("long").alias("n_chars"))


def q_range_filter(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return _round(clean.range_filter(e, "value", 10.0, 100.0))


def q_range_filter_open(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return _round(clean.range_filter(e, "value", lo=0.0))


def _y_strings(li: DataFrame) -> DataFrame:
    q = F.col("l_quantity").cast("string")
    m = F.col("l_linenumber") % 7
    s = (F.when(m == 0, q)
         .when(m == 1, F.concat(q, F.lit(" - "), (F.col("l_quantity") + F.col("l_tax") * 100).cast("string")))
         .when(m == 2, F.concat(F.lit(" "), q, F.lit("d")))
         .when(m == 3, F.concat(F.lit("-"), q))
         .when(m == 4, F.concat(q, F.lit("-")))
         .when(m == 5, F.concat(F.lit("-"), q, F.lit(" - "), F.col("l_tax").cast("string")))
         .otherwise(F.lit("nan")))
    return li.select("l_orderkey", "l_linenumber", s.alias("y_raw"))


def q_parse_range_target(spark, sf):
    s = _y_strings(table(spark, sf, "lineitem"))
    return _round(s.select("l_orderkey", "l_linenumber", parse_number_or_range("y_raw").alias("y")))


def q_training_rows(spark, sf):
    """M1 alignment: vectors ⋈ targets on row id, parse y, drop null y and zero-component vectors."""
    e = table(spark, sf, "embeddings")
    vectors = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vector"))
    targets = e.select(F.col("vec_id").alias("row_id"),
                       F.when(F.col("label") % 4 == 0, F.lit("n/a")).otherwise(F.col("label").cast("string")).alias("y_raw"))
    j = vectors.join(targets, "row_id", "inner").withColumn("y", parse_number_or_range("y_raw"))
    j = clean.drop_zero_vectors(clean.drop_null_target(j, "y"), "vector")
    return _round(j.select("row_id", "y", F.size("vector").cast("long").alias("dim")))


# ---- distribution analysis ----------------------------------------------------------

def _events(spark, sf):
    return table(spark, sf, "events")


def q_describe(spark, sf):
    return _round(stats.describe(_events(spark, sf), "value"))


def q_histogram(spark, sf):
    return _round(stats.histogram(_events(spark, sf), "value"))


def q_skew_kurtosis(spark, sf):
    return _round(stats.skew_kurtosis(_events(spark, sf), "value"))


def q_kde(spark, sf):
    return _round(stats.kde(_events(spark, sf), "value"))


def q_qq_plot(spark, sf):
    return _round(stats.qq_points(_events(spark, sf), "value"))


def q_anderson_darling(spark, sf):
    return _round(stats.anderson_darling(_events(spark, sf), "value"))


def q_transform_candidates(spark, sf):
    e = _events(spark, sf)
    y = stats.values(e, "value")
    mo = stats.moments(y)
    methods = candidate_methods(mo.skew_unbiased, False, include_power=False)
    scores = candidate_skews(e, "value", methods, {})
    best = min((m for m in methods if scores[m] is not None), key=lambda m: abs(scores[m]))
    rows = [(i, m, scores[m], m == best) for i, m in enumerate(methods)]
    return _round(spark.createDataFrame(rows, "candidate int, method string, skewness double, is_best boolean"))


def q_auto_transform(spark, sf):
    e = _events(spark, sf)
    return _round(transform_scores_frame(e, auto_transform(e, "value")))


def q_scalar_transforms(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    cols = [F.col("l_orderkey"), F.col("l_linenumber")]
    for m in ("log1p", "sqrt", "reciprocal", "square"):
        f = TR.forward("l_quantity", m)
        cols += [f.alias(m), TR.inverse(f, m).alias(f"{m}_inv")]
    f = TR.forward("l_discount", "exp")
    cols += [f.alias("exp"), TR.inverse(f, "exp").alias("exp_inv")]
    return _round(li.select(*cols))


def q_power_given_lambda(spark, sf):
    e = _events(spark, sf).select("event_id", "value")
    return _round(e.select("event_id", TR.boxcox("value", 0.25).alias("boxcox"),
                           TR.yeo_johnson(F.col("value") - 50.0, 0.8).alias("yeo_johnson")))


def q_boxcox_fit(spark, sf):
    """λ from the positive values, where alone the family has a likelihood.  Every row is transformed and
    counted: 0 has the limit -1/λ while λ > 0; a value without a finite transform is NULL."""
    e = _events(spark, sf)
    fit = fit_power(e.where(F.col("value") > 0), "value", "boxcox")
    y = F.when((F.col("value") > 0) | (F.lit(fit.lam > 0) & (F.col("value") == 0)), fit.transform("value"))
    return _round(e.select("event_id", nan_to_null(y).alias("y_boxcox")).agg(
        F.lit(fit.lam).alias("lam"), F.skewness("y_boxcox").alias("skew"), F.count(F.lit(1)).alias("n")))


def q_yeo_johnson_fit(spark, sf):
    c = table(spark, sf, "customer")
    fit = scalers.fit_scaler(c, "c_acctbal", "PowerTransformer")
    p = fit.params
    out = _round(c.select(fit.transform("c_acctbal").alias("z")).agg(
        F.lit(p["lam"]).alias("lam"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("std")))
    return out.withColumn("mean", F.col("mean") + 0.0)  # no negative zero


def _scaled(spark, sf, method):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    fit = scalers.fit_scaler(c, "c_acctbal", method)
    return _round(c.select("c_custkey", fit.transform("c_acctbal").alias("scaled")))


def q_scale_standard(spark, sf):
    return _scaled(spark, sf, "StandardScaler")


def q_scale_minmax(spark, sf):
    return _scaled(spark, sf, "MinMaxScaler")


def q_scale_maxabs(spark, sf):
    return _scaled(spark, sf, "MaxAbsScaler")


def q_scale_robust(spark, sf):
    return _scaled(spark, sf, "RobustScaler")


def q_scale_quantile(spark, sf):
    return _scaled(spark, sf, "QuantileTransformer")


# ---- structure profile ----------------------------------------------------------

def structures(spark, sf) -> DataFrame:
    arr = F.array(*[F.lit(s) for s in STRUCTURES])
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("row_id"),
                    F.element_at(arr, (F.col("p_partkey") % len(STRUCTURES)).cast("int") + 1).alias("smiles"),
                    F.col("p_size"))


def _profile(spark, sf):
    return profile.structure_profile(structures(spark, sf), "smiles")


def q_structure_profile(spark, sf):
    p = _profile(spark, sf)
    return _round(p.select(
        "row_id", "is_valid", F.col("n_atoms").cast("long").alias("n_atoms"), "is_aromatic", "is_non_cyclic",
        "is_cyclic_non_aromatic", "category", "molecular_weight",
        profile.canonical_counter_string("elements").alias("elements"),
        profile.canonical_counter_string("element_categories").alias("element_categories")))


def q_size_counts(spark, sf):
    return profile.size_counts(_profile(spark, sf)).select(F.col("n_atoms").cast("long"), "count")


def q_size_bins(spark, sf):
    return profile.binned_size_distribution(_profile(spark, sf), 3)


def q_structural_distribution(spark, sf):
    return profile.structural_distribution(_profile(spark, sf))


def q_elemental_distribution(spark, sf):
    return profile.elemental_distribution(_profile(spark, sf))


def q_top_elements(spark, sf):
    return profile.top_elements(_profile(spark, sf), 5)


def q_element_category_totals(spark, sf):
    return profile.element_category_totals(_profile(spark, sf))


def q_profile_summary(spark, sf):
    return profile.profile_summary(_profile(spark, sf))


def q_profile_filter(spark, sf):
    p = _profile(spark, sf)
    kept = profile.filter_profile(p, min_atoms=2, max_atoms=12, size_count_threshold=10,
                                  elemental_count_threshold=100, filter_elements=["Br"],
                                  filter_structures=["cyclic non-aromatic"])
    train = table(spark, sf, "part").withColumnRenamed("p_partkey", "row_id")
    return _round(profile.semi_join_rows(train, kept).select("row_id", "p_name", "p_size", "p_retailprice"))


# ---- evaluation -----------------------------------------------------------------

def _pred_pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("y_true"),
                     (F.col("l_quantity") * (1 - F.col("l_discount")) + F.col("l_tax") * 10).alias("y_pred"))


def q_prediction_metrics(spark, sf):
    from propkit.operators.evaluate import regression_metrics
    return _round(regression_metrics(_pred_pairs(spark, sf), "y_true", "y_pred"))


def q_prediction_fit(spark, sf):
    from propkit.operators.evaluate import with_linear_fit
    return _round(with_linear_fit(_pred_pairs(spark, sf), "y_true", "y_pred"))


# ---- vectors / neighbours / modelling ------------------------------------------------

def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vector"),
                    F.col("label").cast("double").alias("y"))


def q_vector_standardize(spark, sf):
    from propkit.operators.vectors import standardize_vectors
    s = standardize_vectors(_vectors(spark, sf), "vector", "scaled")
    return _round(s.select(F.col("row_id").alias("vec_id"), F.posexplode("scaled").alias("dim", "z"))
                  .withColumn("dim", F.col("dim").cast("long")))


def q_pca_explained_variance(spark, sf):
    from propkit.operators.vectors import explained_variance, fit_pca_pipeline
    return explained_variance(fit_pca_pipeline(_vectors(spark, sf), "vector", 64), spark)


def q_pca_kmeans(spark, sf):
    from propkit.operators.vectors import fit_pca_pipeline, kmeans_clusters, pca_scores
    v = _vectors(spark, sf)
    scores = pca_scores(fit_pca_pipeline(v, "vector", 10), v, "vector")
    clustered, _ = kmeans_clusters(scores, k=20, seed=42)
    return clustered.select("row_id", "cluster_id")


def q_train_test_split(spark, sf):
    from propkit.operators.model import split_train_test
    return split_train_test(_vectors(spark, sf).select("row_id"), 0.2, seed=42)


def q_knn_predict(spark, sf):
    from propkit.operators.model import split_train_test
    from propkit.operators.neighbors import knn_regress
    s = split_train_test(_vectors(spark, sf), 0.2, seed=42).persist()
    pred = knn_regress(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), k=5)
    return _round(pred)


def q_bootstrap_sample(spark, sf):
    from propkit.operators.model import bootstrap
    b = bootstrap(_vectors(spark, sf), 1000, noise_percentage=5.0, seed=7)
    return _round(b.select("draw", "row_id", "y"))


def _train(spark, sf, model, params=None, transform=None, scaling="StandardScaler"):
    from propkit.operators.model import train_and_evaluate
    res = train_and_evaluate(_vectors(spark, sf), model, params, test_size=0.2, transform=transform, scaling=scaling)
    return _round(res.metrics)


def q_train_linear(spark, sf):
    return _train(spark, sf, "linear_regression")


def q_train_ridge(spark, sf):
    return _train(spark, sf, "ridge", {"alpha": 1.0}, transform="log1p", scaling="MinMaxScaler")


def q_train_rfr(spark, sf):
    return _train(spark, sf, "rfr", {"n_estimators": 20, "max_depth": 5})


def q_train_gbr(spark, sf):
    return _train(spark, sf, "gbr", {"n_estimators": 10, "max_depth": 3}, transform="yeo_johnson",
                  scaling="RobustScaler")


def q_train_knn(spark, sf):
    return _train(spark, sf, "knn", {"n_neighbors": 5})


def q_cross_validation(spark, sf):
    from propkit.operators.model import cross_validate
    return _round(cross_validate(_vectors(spark, sf), "ridge", {"alpha": 1.0}, folds=5))


def q_grid_search(spark, sf):
    from propkit.operators.model import grid_search
    _, res = grid_search(_vectors(spark, sf), "ridge", {"alpha": [0.001, 0.01, 0.1]}, folds=3)
    return _round(res)


def q_random_search(spark, sf):
    from propkit.operators.model import grid_search
    _, res = grid_search(_vectors(spark, sf), "rfr", {"n_estimators": [5, 10], "max_depth": [2, 4]}, folds=3,
                         n_iter=2)
    return res


def q_halving_search(spark, sf):
    from propkit.operators.model import halving_search
    _, hist = halving_search(_vectors(spark, sf), "ridge", {"alpha": [0.001, 0.01, 0.1, 1.0]}, factor=2, folds=3)
    return _round(hist)


def q_score_batch(spark, sf):
    from propkit.operators.model import score, train_and_evaluate
    v = _vectors(spark, sf)
    res = train_and_evaluate(v, "linear_regression", test_size=0.2, transform="sqrt", scaling="StandardScaler")
    return _round(score(res.model, res.prep, v.drop("y")).select("row_id", "predicted_value"))


def q_corpus_structures(spark, sf):
    from propkit.operators.embed import corpus
    c = corpus(structures(spark, sf), "smiles", radius=1)
    return c.select("row_id", F.size("sentence").cast("long").alias("n_ids"),
                    F.array_join("sentence", " ").alias("sentence"))


def q_corpus_documents(spark, sf):
    from propkit.operators.embed import corpus
    d = table(spark, sf, "documents")
    c = corpus(d, "text", radius=1, kind="text")
    return c.select(F.col("doc_id"), F.size("sentence").cast("long").alias("n_ids"),
                    F.md5(F.array_join("sentence", " ")).alias("sentence_md5"))


def q_embed_structures(spark, sf):
    from propkit.operators.embed import corpus, embed_job, train_word2vec, word2vec_embedder
    s = structures(spark, sf)
    model = train_word2vec(corpus(s, "smiles", 1), vector_size=16, seed=42)
    vecs, summary = embed_job(word2vec_embedder(model, 1), s, "smiles")
    return summary


def q_embed_documents(spark, sf):
    from propkit.operators.embed import corpus, embed_job, train_word2vec, word2vec_embedder
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id")
    model = train_word2vec(corpus(d, "text", 1, kind="text"), vector_size=16, min_count=2, seed=42)
    vecs, _ = embed_job(word2vec_embedder(model, 1, kind="text"), d, "text")
    return vecs.select("row_id", "is_valid", F.size("vector").cast("long").alias("dim"))


def q_embed_given_vectors(spark, sf):
    """E8 join path with token vectors derived from the data (deterministic, SQL-checkable):
    vector(token) = [length, code of first char, code of last char]."""
    from propkit.operators.embed import corpus, embed_sum_join
    c = corpus(structures(spark, sf), "smiles", radius=0)
    vocab = c.select(F.explode("sentence").alias("word")).distinct().select(
        "word", F.array(F.length("word").cast("double"), F.ascii("word").cast("double"),
                        F.ascii(F.reverse("word")).cast("double")).alias("vector"))
    e = embed_sum_join(vocab, c, "sentence", "row_id")
    return _round(e.select("row_id", "is_valid", F.col("vector")[0].alias("v0"), F.col("vector")[1].alias("v1"),
                           F.col("vector")[2].alias("v2")))


def q_predict_structures(spark, sf):
    """E6 → E7 → E8 → M1 → M5 → M19 on the part-derived structures: train on the valid
    rows' embeddings against p_retailprice, then score every structure string."""
    from propkit.operators.embed import corpus, train_word2vec, word2vec_embedder
    from propkit.operators.model import predict_from_strings, train_and_evaluate, training_set
    s = structures(spark, sf)
    w2v = train_word2vec(corpus(s, "smiles", 1), vector_size=8, seed=42)
    emb = word2vec_embedder(w2v, 1)
    vecs = emb(s, "smiles").where(F.col("is_valid"))
    targets = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), "p_retailprice")
    data = training_set(vecs, targets, "p_retailprice")
    res = train_and_evaluate(data, "linear_regression", test_size=0.2, scaling="StandardScaler")
    pred, _ = predict_from_strings(emb, res.model, res.prep, s, "smiles")
    return pred.select("row_id", "predicted_value")


def q_invalid_structures(spark, sf):
    """The invalid-row output of the profile job."""
    from propkit.operators.clean import split_valid
    _, invalid = split_valid(_profile(spark, sf))
    return invalid.select("row_id", "smiles")


def q_clean_documents(spark, sf):
    """P2 over whole texts: non-breaking spaces removed, trimmed, literal 'nan' → NULL."""
    from propkit.functions.parse import clean_text
    d = table(spark, sf, "documents").select("doc_id", clean_text("text").alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


def q_dedup_summary(spark, sf):
    return clean.dedup_summary(table(spark, sf, "part"), "p_name")
