"""Power transforms with maximum-likelihood λ (F6, F7) and automatic choice.

λ maximises the profile log-likelihood ``(λ - 1) c - n/2 log var T(y, λ)``.  It is found by a
safeguarded Newton iteration: each pass is one aggregate that gives the variance of the
transformed column with its first and second derivative for every family that is still
open, so the score and its slope are exact.  The zero of the score is kept in a bracket; a
Newton step that leaves the bracket, or a λ at which the transform overflows, is replaced by
bisection, and the bracket is opened by doubling steps where no end is known yet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propkit.functions import transforms as TR
from propkit.operators.stats import moments, values

NEAR_ZERO = 1e-4  # exponents this close to 0 use the power series


def _power(log: Column, lam) -> tuple[Column, Column, Column]:
    """``(x**lam - 1) / lam`` of ``x = exp(log)`` and its first two derivatives by ``lam``, a
    number or a column."""
    if not isinstance(lam, Column) and abs(lam) < NEAR_ZERO:
        sq, cu = log * log, log * log * log
        return log + sq * (lam / 2) + cu * (lam * lam / 6), sq / 2 + cu * (lam / 3), cu / 3 + cu * log * (lam / 4)
    p = F.exp(log * lam)
    z = (p - 1.0) / lam
    z1 = (p * log - z) / lam
    return z, z1, (p * log * log - 2.0 * z1) / lam


def _derivatives(name: str, lam: float) -> tuple[Column, Column, Column]:
    """T(y, lam) and its first two derivatives by lam, over the columns of ``_logs``."""
    if name == "boxcox":
        return _power(F.col("ln"), lam)
    plus, log = F.col("y") >= 0, F.col("ln1")
    if min(abs(lam), abs(2.0 - lam)) < NEAR_ZERO:
        pos, neg = _power(log, lam), _power(log, 2.0 - lam)
        return tuple(F.when(plus, a).otherwise(b * sign) for a, b, sign in zip(pos, neg, (-1.0, 1.0, -1.0)))
    z, z1, z2 = _power(log, F.when(plus, lam).otherwise(2.0 - lam))  # one expression for both signs
    sign = F.when(plus, 1.0).otherwise(-1.0)
    return z * sign, z1, z2 * sign


def _logs(y: DataFrame) -> DataFrame:
    """The logarithms that every pass needs, computed once."""
    return y.select("y", F.when(F.col("y") > 0, F.ln("y")).alias("ln"), F.log1p(F.abs("y")).alias("ln1"))


@dataclass
class _Search:
    """The bracketed zero of the score of one family; ``c`` is the sum of its Jacobian's logarithms."""

    name: str
    c: float
    n: int
    lam: float = 1.0
    lo: float = -math.inf
    hi: float = math.inf
    step: float = 1.0
    overflow: bool = False  # an end of the bracket is where the transform leaves the doubles
    best: float | None = None

    def move(self, v: float | None, v1: float | None, v2: float | None, tol: float) -> None:
        """Take in the variance and its derivatives at ``lam`` and choose the next one."""
        if not all(x is not None and math.isfinite(x) for x in (v, v1, v2)) or v <= 0:
            # the transform over- or underflows: powers nearer to 1 do not
            self.overflow = True
            if self.lam >= 1.0:
                self.hi = min(self.hi, self.lam)
            else:
                self.lo = max(self.lo, self.lam)
            self._next(None, self.lam < 1.0)
            return
        score, slope = self.c - self.n / 2 * v1 / v, -self.n / 2 * (v2 / v - (v1 / v) ** 2)
        if score > 0:
            self.lo = max(self.lo, self.lam)
        else:
            self.hi = min(self.hi, self.lam)
        newton = self.lam - score / slope if slope < 0 else None
        if newton is not None and abs(newton - self.lam) <= tol * max(1.0, abs(self.lam)):
            self.best = newton
            return
        self._next(newton, score > 0)

    def _next(self, newton: float | None, up: bool) -> None:
        closed = math.isfinite(self.lo) and math.isfinite(self.hi)
        if closed and self.hi - self.lo <= 1e-12 * max(1.0, abs(self.lo)):
            if self.overflow:
                raise ValueError(f"{self.name}: the likelihood grows until the transform overflows")
            self.best = (self.lo + self.hi) / 2
        elif newton is not None and self.lo < newton < self.hi and (closed or abs(newton - self.lam) <= 8 * self.step):
            self.lam = newton
        elif closed:
            self.lam = (self.lo + self.hi) / 2
        else:
            if not self.step < 1e9:
                raise ValueError(f"{self.name}: the likelihood has no maximum at a finite lambda")
            self.lam, self.step = self.lam + (self.step if up else -self.step), self.step * 2


def _maximise(y: DataFrame, searches: list[_Search], tol: float = 1e-9) -> None:
    """One aggregate a pass for all open searches."""
    for _ in range(200):
        active = [s for s in searches if s.best is None]
        if not active:
            return
        aggs = []
        for i, s in enumerate(active):
            z, z1, z2 = _derivatives(s.name, s.lam)
            aggs += [F.var_pop(z).alias(f"v{i}"), (2.0 * F.covar_pop(z, z1)).alias(f"a{i}"),
                     (2.0 * (F.var_pop(z1) + F.covar_pop(z, z2))).alias(f"b{i}")]
        r = y.agg(*aggs).first()
        for i, s in enumerate(active):
            s.move(r[f"v{i}"], r[f"a{i}"], r[f"b{i}"], tol)
    raise ValueError(f"no lambda found for {[s.name for s in searches if s.best is None]}")


def fit_lambdas(df: DataFrame, col: str, methods: list[str], **kw) -> dict[str, float]:
    """F6/F7 λ by maximum likelihood for any of ``boxcox`` / ``yeo_johnson`` at once.  A constant
    column has no likelihood to maximise and keeps λ = 1."""
    y = _logs(values(df, col)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        r = y.agg(F.count("y").alias("n"), F.min("y").alias("mn"), F.max("y").alias("mx"),
                  F.sum("ln").alias("sl"), F.sum(F.signum("y") * F.col("ln1")).alias("sy")).first()
        n = r["n"]
        if "boxcox" in methods and (n == 0 or r["mn"] <= 0):
            raise ValueError("Box-Cox needs strictly positive data")
        if n and not (math.isfinite(r["mn"]) and math.isfinite(r["mx"])):
            raise ValueError(f"{col}: infinite values have no likelihood")
        c = {"boxcox": r["sl"], "yeo_johnson": r["sy"]}
        constant = n == 0 or r["mn"] == r["mx"]
        found = [_Search(m, c[m], n, best=1.0 if constant else None) for m in ("boxcox", "yeo_johnson") if m in methods]
        _maximise(y, found, **kw)
        return {s.name: s.best for s in found}
    finally:
        y.unpersist()


def boxcox_lambda(df: DataFrame, col: str, **kw) -> float:
    """F6 λ by maximum likelihood; requires every value > 0."""
    return fit_lambdas(df, col, ["boxcox"], **kw)["boxcox"]


def yeo_johnson_lambda(df: DataFrame, col: str, **kw) -> float:
    """F7 λ by maximum likelihood."""
    return fit_lambdas(df, col, ["yeo_johnson"], **kw)["yeo_johnson"]


@dataclass
class PowerFit:
    method: str  # boxcox | yeo_johnson
    lam: float
    mean: float | None = None  # yeo_johnson output is standardised (population std)
    std: float | None = None

    def transform(self, col):
        if self.method == "boxcox":
            return TR.boxcox(col, self.lam)
        return (TR.yeo_johnson(col, self.lam) - self.mean) / self.std

    def inverse(self, col):
        c = F.col(col) if isinstance(col, str) else col
        if self.method == "boxcox":
            return TR.boxcox_inverse(c, self.lam)
        return TR.yeo_johnson_inverse(c * self.std + self.mean, self.lam)

    def to_dict(self):
        return {"method": self.method, "lam": self.lam, "mean": self.mean, "std": self.std}


def fit_power(df: DataFrame, col: str, method: str, **kw) -> PowerFit:
    return fit_powers(df, col, [method], **kw)[method]


def fit_powers(df: DataFrame, col: str, methods: list[str], **kw) -> dict[str, PowerFit]:
    """Fit several power transforms with shared passes; Yeo-Johnson also gets its
    standardisation (mean, population std) from one more aggregate."""
    lams = fit_lambdas(df, col, methods, **kw)
    out = {}
    if "boxcox" in lams:
        out["boxcox"] = PowerFit("boxcox", lams["boxcox"])
    if "yeo_johnson" in lams:
        lam = lams["yeo_johnson"]
        t = TR.yeo_johnson(F.col("y"), lam)
        r = values(df, col).agg(F.avg(t).alias("m"), F.stddev_pop(t).alias("s")).first()
        out["yeo_johnson"] = PowerFit("yeo_johnson", lam, r["m"], r["s"] if r["s"] else 1.0)
    return out


@dataclass
class TransformChoice:
    skew_before: float | None
    scores: dict = field(default_factory=dict)
    best: str | None = None
    fits: dict = field(default_factory=dict)


def candidate_methods(skew: float | None, all_positive: bool, include_power: bool = True) -> list[str]:
    """A19 candidates in the reference's order (first wins ties)."""
    c = ["original"]
    if skew is not None and skew > 0:
        c += ["log1p", "sqrt", "reciprocal"]
    elif skew is not None and skew < 0:
        c += ["square", "exp"]
    if include_power:
        if all_positive:
            c.append("boxcox")
        c.append("yeo_johnson")
    return c


def candidate_skews(df: DataFrame, col: str, methods: list[str], fits: dict) -> dict:
    """Biased skewness of every candidate in one aggregate; a candidate with any
    NULL/NaN/infinite transformed value scores NULL (it can never win)."""
    y = values(df, col)
    aggs = [F.count("y").alias("n")]
    for i, m in enumerate(methods):
        t = fits[m].transform(F.col("y")) if m in fits else TR.forward(F.col("y"), m)
        t = F.when(F.isnan(t) | (F.abs(t) == float("inf")), F.lit(None).cast("double")).otherwise(t)
        aggs += [F.skewness(t).alias(f"s{i}"), F.count(t).alias(f"c{i}")]
    r = y.agg(*aggs).first()
    out = {}
    for i, m in enumerate(methods):
        s = r[f"s{i}"]
        ok = s is not None and r[f"c{i}"] == r["n"] and math.isfinite(s)
        out[m] = s if ok else None
    return out


def auto_transform(df: DataFrame, col: str, include_power: bool = True) -> TransformChoice:
    """Pick the transform with the smallest |skewness| (G1 drives the branch)."""
    y = values(df, col)
    mo = moments(y)
    methods = candidate_methods(mo.skew_unbiased, mo.n > 0 and mo.min is not None and mo.min > 0, include_power)
    power = [m for m in methods if m in ("boxcox", "yeo_johnson")] if mo.std else []
    methods = [m for m in methods if m not in ("boxcox", "yeo_johnson") or m in power]
    fits = fit_powers(df, col, power) if power else {}
    scores = candidate_skews(df, col, methods, fits)
    best = None
    for m in methods:
        s = scores[m]
        if s is not None and (best is None or abs(s) < abs(scores[best])):
            best = m
    # no finite score at all (e.g. a constant column): the first candidate stands
    return TransformChoice(mo.skew_unbiased, scores, best or methods[0], fits)


def transform_scores_frame(df: DataFrame, choice: TransformChoice) -> DataFrame:
    rows = [(i, m, s, m == choice.best, choice.fits[m].lam if m in choice.fits else None)
            for i, (m, s) in enumerate(choice.scores.items())]
    return df.sparkSession.createDataFrame(
        rows, "candidate int, method string, skewness double, is_best boolean, lam double")
