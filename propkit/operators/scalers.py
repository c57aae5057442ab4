"""Fitted target scalers (C1–C6): fit → small parameter record → Column expressions.

Parameters follow scikit-learn's definitions (population std; a zero scale is
replaced by 1) rather than Spark ML's scalers (sample std; 0.5 for constant
columns).  Quantiles are exact (selection by bracket counts).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propkit.operators.power import fit_power, PowerFit
from propkit.operators.stats import Ranked, values

SCALERS = ("StandardScaler", "MinMaxScaler", "MaxAbsScaler", "RobustScaler", "QuantileTransformer",
           "PowerTransformer")


def _nz(v):
    return 1.0 if v is None or v == 0 else v


@dataclass
class FittedScaler:
    method: str
    params: dict = field(default_factory=dict)

    def transform(self, col) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        p = self.params
        if self.method == "StandardScaler":
            return (c - p["mean"]) / p["scale"]
        if self.method == "MinMaxScaler":
            return (c - p["min"]) / p["scale"]
        if self.method == "MaxAbsScaler":
            return c / p["scale"]
        if self.method == "RobustScaler":
            return (c - p["center"]) / p["scale"]
        if self.method == "QuantileTransformer":
            return _quantile_forward(p["quantiles"], p["references"])(c)
        if self.method == "PowerTransformer":
            return PowerFit(**p).transform(c)
        raise ValueError(f"unknown scaler {self.method}")

    def inverse(self, col) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        p = self.params
        if self.method == "StandardScaler":
            return c * p["scale"] + p["mean"]
        if self.method == "MinMaxScaler":
            return c * p["scale"] + p["min"]
        if self.method == "MaxAbsScaler":
            return c * p["scale"]
        if self.method == "RobustScaler":
            return c * p["scale"] + p["center"]
        if self.method == "QuantileTransformer":
            return _quantile_inverse(p["quantiles"], p["references"])(c)
        if self.method == "PowerTransformer":
            return PowerFit(**p).inverse(c)
        raise ValueError(f"unknown scaler {self.method}")

    def to_json(self) -> str:
        return json.dumps({"method": self.method, "params": self.params})

    @staticmethod
    def from_json(text: str) -> "FittedScaler":
        d = json.loads(text)
        return FittedScaler(d["method"], d["params"])


def _need(v, method):
    if v is None:
        raise ValueError(f"{method}: no non-null values to fit")
    return v


def fit_scaler(df: DataFrame, col: str, method: str, n_quantiles: int = 1000) -> FittedScaler:
    y = values(df, col)
    if method == "StandardScaler":
        r = y.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
        return FittedScaler(method, {"mean": _need(r["m"], method), "scale": _nz(r["s"])})
    if method == "MinMaxScaler":
        r = y.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
        lo, hi = _need(r["lo"], method), r["hi"]
        return FittedScaler(method, {"min": lo, "scale": _nz(hi - lo)})
    if method == "MaxAbsScaler":
        r = y.agg(F.max(F.abs("y")).alias("a")).first()
        return FittedScaler(method, {"scale": _nz(_need(r["a"], method))})
    if method == "RobustScaler":
        q1, med, q3 = Ranked(y).quantiles([0.25, 0.5, 0.75])
        _need(med, method)
        return FittedScaler(method, {"center": med, "scale": _nz(q3 - q1)})
    if method == "QuantileTransformer":
        rk = Ranked(y)
        if rk.n == 0:
            raise ValueError(f"{method}: no non-null values to fit")
        nq = max(1, min(n_quantiles, rk.n))
        refs = np.linspace(0, 1, nq).tolist()
        qs = rk.quantiles(refs)
        return FittedScaler(method, {"quantiles": qs, "references": refs})
    if method == "PowerTransformer":
        return FittedScaler(method, fit_power(df, col, "yeo_johnson").to_dict())
    raise ValueError(f"unknown scaler {method}; choose one of {SCALERS}")


def _quantile_forward(quantiles, references):
    qs = np.asarray(quantiles, dtype=float)
    refs = np.asarray(references, dtype=float)

    @F.pandas_udf("double")
    def fwd(s: pd.Series) -> pd.Series:
        x = s.to_numpy(dtype=float)
        # average of increasing and decreasing interpolation handles repeated quantiles
        a = np.interp(x, qs, refs)
        b = -np.interp(-x, -qs[::-1], -refs[::-1])
        return pd.Series(np.clip(0.5 * (a + b), 0.0, 1.0))

    return fwd


def _quantile_inverse(quantiles, references):
    qs = np.asarray(quantiles, dtype=float)
    refs = np.asarray(references, dtype=float)

    @F.pandas_udf("double")
    def inv(s: pd.Series) -> pd.Series:
        return pd.Series(np.interp(s.to_numpy(dtype=float), refs, qs))

    return inv
