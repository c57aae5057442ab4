"""Vector analytics (V1–V5): standardise → PCA → K-means, saved as a pipeline.

Vectors live as ``ARRAY<DOUBLE>`` in tables; ML stages see ``VectorUDT`` through
``array_to_vector``.  Per-dimension statistics come from one ``Summarizer`` pass
(a typed aggregate with map-side combine); only ``d``-sized arrays reach the driver.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, ElementwiseProduct, PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_vector(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def vector_stats(df: DataFrame, array_col: str):
    """(n, mean[d], population std[d]) in one aggregate."""
    v = as_vector(df.where(F.col(array_col).isNotNull()), array_col, "_v")
    r = v.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).first()["s"]
    n = int(r["count"])
    mean = r["mean"].toArray().tolist()
    var = r["variance"].toArray().tolist()
    std = [math.sqrt(x * (n - 1) / n) if n > 1 else 0.0 for x in var]
    return n, mean, [s if s > 0 else 1.0 for s in std]


def standardize_vectors(df: DataFrame, array_col: str, out: str = "scaled") -> DataFrame:
    """V1: per-dimension (x − mean) / population std (zero std → 1), as an array."""
    _, mean, std = vector_stats(df, array_col)
    m = F.array(*[F.lit(x) for x in mean])
    s = F.array(*[F.lit(x) for x in std])
    return df.withColumn(out, F.transform(F.col(array_col).cast("array<double>"),
                                          lambda x, i: (x - F.element_at(m, i + 1)) / F.element_at(s, i + 1)))


def fit_pca_pipeline(df: DataFrame, array_col: str, k: int = 70) -> PipelineModel:
    """V2 + V5: StandardScaler (sample std) × √(n/(n−1)) = population scaling, then PCA(k),
    then a fixed sign per component (its largest-|loading| is positive).

    Spark's PCA does not centre on transform; the scaler centres first.  The signs are a
    stage of the pipeline, so a saved pipeline gives the scores it was made with.  NULL
    vectors are left out of the fit; ``k`` beyond the dimension is an error.
    """
    rows = df.where(F.col(array_col).isNotNull())
    n, mean, _ = vector_stats(rows, array_col)
    d = len(mean)
    if k > d:
        raise ValueError(f"{k} components asked of {d} dimensions")
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    pipe = Pipeline(stages=[
        StandardScaler(inputCol="features", outputCol="_std", withMean=True, withStd=True),
        ElementwiseProduct(inputCol="_std", outputCol="_pop", scalingVec=Vectors.dense([factor] * d)),
        PCA(k=k, inputCol="_pop", outputCol="_pc"),
    ])
    fitted = pipe.fit(as_vector(rows, array_col))
    pc = fitted.stages[-1].pc.toArray()  # d × k
    signs = [1.0 if c[abs(c).argmax()] >= 0 else -1.0 for c in pc.T]
    return PipelineModel([*fitted.stages, ElementwiseProduct(inputCol="_pc", outputCol="pca", scalingVec=Vectors.dense(signs))])


def pca_scores(model: PipelineModel, df: DataFrame, array_col: str, out: str = "pca") -> DataFrame:
    """Scores of every row as an array; a NULL vector has NULL scores."""
    d = model.stages[1].getScalingVec().size
    filled = df.withColumn("_in", F.coalesce(F.col(array_col).cast("array<double>"), F.array_repeat(F.lit(0.0), d)))
    scored = model.transform(as_vector(filled, "_in"))
    res = F.when(F.col(array_col).isNotNull(), vector_to_array("pca"))
    return scored.withColumn("_res", res).drop("features", "_in", "_std", "_pop", "_pc", "pca").withColumn(
        out, F.col("_res")).drop("_res")


def explained_variance(model: PipelineModel, spark) -> DataFrame:
    """V3: (component, ratio)."""
    ratios = next(s for s in model.stages if isinstance(s, PCAModel)).explainedVariance.toArray().tolist()
    return spark.createDataFrame([(i, float(r)) for i, r in enumerate(ratios)], "component int, ratio double")


def kmeans_clusters(scores: DataFrame, k: int = 20, seed: int = 42, col: str = "pca"):
    """V4: K-means on PCA scores → ``cluster_id`` (model returned for reuse)."""
    v = as_vector(scores, col, "_km")
    rows = v.select("_km").persist()  # K-means reads its input once per iteration
    km = KMeans(k=k, seed=seed, featuresCol="_km", predictionCol="cluster_id").fit(rows)
    rows.unpersist()
    return km.transform(v).drop("_km"), km
