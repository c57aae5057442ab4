"""Scalar forward/inverse transforms of a target column (F1–F7) as Columns.

ANSI mode is on in Spark 4, so divisions use ``try_divide`` and results that NumPy
would give as NaN (sqrt of a negative, log of a non-positive) come out as NULL.
Infinite results (exp overflow) are kept; consumers treat them as non-finite.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from propkit.functions.parse import nan_to_null

SIMPLE_METHODS = ("log1p", "sqrt", "reciprocal", "square", "exp")
EPS = 2.220446049250313e-16  # spacing(1.0)


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def forward(col, method: str) -> Column:
    """F1–F5 forward; unknown method is the identity."""
    y = _c(col)
    if method == "log1p":
        return F.log1p(y)
    if method == "sqrt":
        return nan_to_null(F.sqrt(y))
    if method == "reciprocal":
        return F.try_divide(F.lit(1.0), y + 1.0)
    if method == "square":
        return F.pow(y, 2.0)
    if method == "exp":
        return F.exp(y)
    return y


def inverse(col, method: str) -> Column:
    """F1–F5 inverse; unknown method is the identity."""
    y = _c(col)
    if method == "log1p":
        return F.expm1(y)
    if method == "sqrt":
        return F.pow(y, 2.0)
    if method == "reciprocal":
        return F.try_divide(F.lit(1.0), y) - 1.0
    if method == "square":
        return nan_to_null(F.sqrt(y))
    if method == "exp":
        return F.ln(y)
    return y


def boxcox(col, lam: float) -> Column:
    """F6 forward for a fitted λ (input must be > 0)."""
    y = _c(col)
    if abs(lam) < EPS:
        return F.ln(y)
    return (F.pow(y, F.lit(lam)) - 1.0) / lam


def boxcox_inverse(col, lam: float) -> Column:
    y = _c(col)
    if abs(lam) < EPS:
        return F.exp(y)
    return nan_to_null(F.pow(y * lam + 1.0, F.lit(1.0 / lam)))


def yeo_johnson(col, lam: float) -> Column:
    """F7 forward (before standardisation) for a fitted λ."""
    y = _c(col)
    pos = F.log1p(y) if abs(lam) < EPS else (F.pow(y + 1.0, F.lit(lam)) - 1.0) / lam
    neg = -F.log1p(-y) if abs(lam - 2.0) < EPS else -(F.pow(1.0 - y, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    return F.when(y >= 0, pos).otherwise(neg)


def yeo_johnson_inverse(col, lam: float) -> Column:
    x = _c(col)
    pos = F.expm1(x) if abs(lam) < EPS else F.pow(x * lam + 1.0, F.lit(1.0 / lam)) - 1.0
    neg = (1.0 - F.exp(-x)) if abs(lam - 2.0) < EPS else 1.0 - F.pow(-(2.0 - lam) * x + 1.0, F.lit(1.0 / (2.0 - lam)))
    return nan_to_null(F.when(x >= 0, pos).otherwise(neg))
