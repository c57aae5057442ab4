"""Regression metrics (A17), least-squares line of prediction on truth (A18) and
prediction analysis over two columns (M20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, y_true: str, y_pred: str, by: list[str] | None = None) -> DataFrame:
    """R², MSE, RMSE, MAE and the fitted line (slope, intercept) in one aggregate.

    R² = 1 − SS_res / SS_tot with SS_tot = n·var_pop(y) (scikit-learn's definition,
    not the squared correlation ``regr_r2``); NULL for a constant truth.
    """
    t, p = F.col(y_true), F.col(y_pred)
    err = t - p
    aggs = [
        F.count(F.lit(1)).alias("n"),
        (1.0 - F.try_divide(F.sum(err * err), F.var_pop(t) * F.count(t))).alias("r2"),
        F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.regr_slope(p, t).alias("slope"),
        F.regr_intercept(p, t).alias("intercept"),
    ]
    g = df.groupBy(*by) if by else df
    return g.agg(*aggs)


def with_linear_fit(df: DataFrame, y_true: str, y_pred: str, by: list[str] | None = None,
                    out: str = "y_linear_fit") -> DataFrame:
    """Append slope·y_true + intercept; the per-group line is a small aggregate joined
    back on the group keys (one row per group; the planner picks the join)."""
    if by:
        line = df.groupBy(*by).agg(F.regr_slope(y_pred, y_true).alias("_m"), F.regr_intercept(y_pred, y_true).alias("_c"))
        j = df.join(line, by, "left")
    else:
        r = df.agg(F.regr_slope(y_pred, y_true).alias("_m"), F.regr_intercept(y_pred, y_true).alias("_c")).first()
        j = df.withColumn("_m", F.lit(r["_m"])).withColumn("_c", F.lit(r["_c"]))
    return j.withColumn(out, F.col("_m") * F.col(y_true) + F.col("_c")).drop("_m", "_c")


def prediction_analysis(df: DataFrame, column_x: str, column_y: str) -> DataFrame:
    """Metrics of ``column_y`` (predicted) against ``column_x`` (true)."""
    return regression_metrics(df, column_x, column_y)
