import os

import pytest
from pyspark.sql import functions as F

from propkit.operators.model import load_trained, save_trained, score, train_and_evaluate
from propkit.plans import jobs
from propkit.plans.queries import structures
from propkit.sources.readers import read_table
from propkit.sources.sinks import read_vectors, write_table, write_vectors
from propkit.streaming import apply_row_operators
from tests.conftest import SF


def test_distribution_report(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    r = jobs.distribution_report(e, "value", auto=True)
    assert r["applied_transformation"] in ("original", "log1p", "sqrt", "reciprocal", "boxcox", "yeo_johnson")
    assert r["histogram"].count() > 0 and r["kde"].count() == 100
    assert r["qq_plot"].count() == r["descriptive_statistics"].first()["count"]
    r["_release"]()


def test_profile_jobs_roundtrip(spark, tmp_path):
    s = structures(spark, SF)
    res = jobs.profile_job(spark, s, "smiles", str(tmp_path / "prof"), bin_size=3)
    assert res["summary"].first()["n_rows"] == s.count()
    part = spark.read.parquet(f"{SF}/part.parquet").withColumnRenamed("p_partkey", "row_id")
    kept = jobs.profile_filter_job(spark, part, str(tmp_path / "prof"), min_atoms=2, filter_structures=["aromatic"])
    assert 0 < kept.count() < part.count()


def test_distributions_from_csv_profile_and_index_job(spark, tmp_path):
    s = structures(spark, SF)
    jobs.profile_job(spark, s, "smiles", str(tmp_path / "p"), bin_size=3, csv_copy=True)
    a = jobs.distributions_from_profile(spark, str(tmp_path / "p/profile"), "elemental_distribution")
    b = jobs.distributions_from_profile(spark, str(tmp_path / "p/profile_csv"), "elemental_distribution", fmt="csv")
    assert sorted(a["elemental_distribution"].collect()) == sorted(b["elemental_distribution"].collect())
    idx = jobs.make_index_job(spark, f"{SF}/events.parquet", "idx", str(tmp_path / "ix"))
    assert idx.columns[0] == "idx" and sorted(r[0] for r in idx.select("idx").collect()) == list(range(idx.count()))
    keep = jobs.make_index_job(spark, f"{SF}/events.parquet", "event_id", str(tmp_path / "ix2"))
    assert keep.columns[0] == "event_id"


def test_sinks_and_csv_roundtrip(spark, tmp_path):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice")
    write_table(o, str(tmp_path / "o.csv"), fmt="csv")
    back = read_table(spark, str(tmp_path / "o.csv"), filetype="csv")
    assert back.count() == o.count()
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    write_vectors(e.withColumnRenamed("vec_id", "row_id"), str(tmp_path / "vec"), vec_col="embedding")
    assert read_vectors(spark, str(tmp_path / "vec")).count() == e.count()


def test_model_save_load_score(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vector"),
                 F.col("label").cast("double").alias("y"))
    res = train_and_evaluate(v, "linear_regression", test_size=0.2, transform="log1p", scaling="StandardScaler")
    path = save_trained(res, str(tmp_path / "m"))
    model, prep = load_trained(spark, path)
    a = score(model, prep, v.drop("y")).orderBy("row_id").collect()
    b = score(res.model, res.prep, v.drop("y")).orderBy("row_id").collect()
    assert all(abs(x["predicted_value"] - y["predicted_value"]) < 1e-9 for x, y in zip(a, b))


def test_streaming_row_operators(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src)
    spark.createDataFrame([("1.5", "CCO"), ("2 - 4", "c1ccccc1"), ("x", "C")], "y string, s string") \
        .write.parquet(str(src / "batch0"))
    stream = spark.readStream.schema("y string, s string").parquet(str(src / "batch0"))
    q = (apply_row_operators(stream, "y", lo=0.0, structure_col="s").writeStream.format("memory")
         .queryName("rowops").option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT y, n_atoms FROM rowops").collect()
    assert sorted((r["y"], r["n_atoms"]) for r in rows) == [(1.5, 3), (3.0, 6)]


def test_train_job_with_search_and_cv(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    vecs = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    targets = e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("label"))
    out = jobs.train_job(vecs, targets, "label", model="ridge", fine_tune_model=True,
                         grid_search_method="DaskRandomizedSearchCV", fine_tuned_hyperparameters={"alpha": [0.1, 1.0]},
                         grid_search_parameters={"n_iter": 2}, cv_fold=3, save_to=str(tmp_path / "run"))
    assert out["search_results"].count() == 2 and "regParam" in out["best_params"]
    assert sorted(r["split"] for r in out["metrics"].collect()) == ["test", "train"]
    out2 = jobs.train_job(vecs, targets, "label", model="linear_regression", bootstrap=True, bootstrap_nsamples=300,
                          noise_percentage=2.0, cross_validation=True, cv_fold=3)
    assert out2["n_rows"] == 300 and out2["cv_scores"].count() == 3


def test_reduction_word2vec_and_predict_jobs(spark, tmp_path):
    from pyspark.ml.feature import Word2VecModel

    from propkit.operators.embed import word2vec_embedder
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("row_id"),
                                                               F.col("embedding").alias("vector"))
    red = jobs.vector_reduction_job(spark, e, str(tmp_path / "red"), pca_dim=5, n_clusters=4, compute_kmeans=True)
    assert red["scores"].select("cluster_id").distinct().count() <= 4
    assert red["explained_variance"].count() == 5
    s = structures(spark, SF)
    w2v = jobs.word2vec_job(spark, s, "smiles", str(tmp_path / "w2v"), vector_size=6, min_count=1)
    assert Word2VecModel.load(str(tmp_path / "w2v/word2vec")).getVectorSize() == 6
    emb = word2vec_embedder(w2v, 1)
    part = spark.read.parquet(f"{SF}/part.parquet").select(F.col("p_partkey").alias("row_id"), "p_retailprice")
    out = jobs.train_job(emb(s, "smiles").where("is_valid"), part, "p_retailprice", save_to=str(tmp_path / "run"))
    assert out["metrics"].count() == 2
    pred = jobs.predict_job(spark, s.drop("row_id"), "smiles", str(tmp_path / "run/model"), emb,
                            out=str(tmp_path / "pred"))
    n_valid = emb(s, "smiles").where("is_valid").count()
    assert pred.count() == n_valid and "predicted_value" in pred.columns and "p_size" in pred.columns
    one = out["summary"].collect()[0]
    assert out["summary"].count() == spark.read.parquet(str(tmp_path / "run/results/summary")).count() == 1
    assert one.n_features == 6 and one.train_rows + one.test_rows == one.n_rows and one.train_min <= one.train_mean <= one.train_max and one.seconds > 0
    # without a lineage the embedding is unknown, with one it is found
    with pytest.raises(FileNotFoundError):
        jobs.predict_job(spark, s.drop("row_id"), "smiles", str(tmp_path / "run/model"))
    jobs.write_sidecar(spark, str(tmp_path / "run/model/lineage"), {"word2vec": str(tmp_path / "w2v/word2vec"), "radius": 1, "kind": "structure"})
    again = jobs.predict_job(spark, s.drop("row_id"), "smiles", str(tmp_path / "run/model"))
    key = lambda df: sorted((r.row_id, round(r.predicted_value, 9)) for r in df.collect())
    assert key(again) == key(pred)


def test_filter_job_reads_the_metadata(spark, tmp_path):
    part = structures(spark, SF)
    with pytest.raises(FileNotFoundError):
        jobs.profile_filter_job(spark, part, str(tmp_path / "none"))
    jobs.profile_job(spark, part.withColumnRenamed("row_id", "key"), "smiles", str(tmp_path / "prof"), id_col="key")
    kept = jobs.profile_filter_job(spark, part.withColumnRenamed("row_id", "key"), str(tmp_path / "prof"), out=str(tmp_path / "kept"), min_atoms=3)
    n = kept.count()
    assert 0 < n == spark.read.parquet(str(tmp_path / "kept/training")).count() == spark.read.parquet(str(tmp_path / "kept/profile")).count()
    assert jobs.read_sidecar(spark, str(tmp_path / "kept/metadata"))["filters"] == {"min_atoms": 3}
