"""Sinks: derived tables (S7), vector store (S9), models and scalers (S11),
results (S12) and one-row JSON sidecars carrying lineage."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write a derived table (a directory of part files)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unknown sink format {fmt}")
    return path


def write_vectors(df: DataFrame, path: str, id_col: str = "row_id", vec_col: str = "vector") -> str:
    """(row_id, vector ARRAY<DOUBLE>) parquet; every vector must have one length."""
    v = df.select(F.col(id_col).alias("row_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    sizes = v.where(F.col("vector").isNotNull()).agg(F.min(F.size("vector")).alias("a"),
                                                     F.max(F.size("vector")).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"vectors have different lengths ({sizes['a']}..{sizes['b']})")
    v.write.mode("overwrite").parquet(path)
    return path


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_sidecar(spark: SparkSession, path: str, record: dict) -> str:
    """One-row JSON dataset beside a model/vector output (lineage, arguments)."""
    spark.createDataFrame([(json.dumps(record, default=str),)], "record string").coalesce(1) \
        .write.mode("overwrite").text(path)
    return path


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """The record written by :func:`write_sidecar`; ``FileNotFoundError`` where there is none."""
    from pyspark.errors import AnalysisException
    try:
        row = spark.read.text(path).first()
    except AnalysisException as exc:
        raise FileNotFoundError(f"no sidecar at {path}") from exc
    if row is None:
        raise FileNotFoundError(f"no sidecar at {path}")
    return json.loads(row[0])


def save_model(model, path: str) -> str:
    """Spark ML (Pipeline)Model persistence."""
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def write_results(pred: DataFrame, metrics: DataFrame, path: str, summary: DataFrame | None = None) -> str:
    """Per-row (split, row_id, y_true, y_pred, y_linear_fit), the metrics table and the
    one-row summary of the run."""
    if summary is not None:
        summary.write.mode("overwrite").parquet(f"{path}/summary")
    pred.write.mode("overwrite").parquet(f"{path}/predictions")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    return path
