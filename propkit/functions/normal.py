"""Standard normal CDF, log-CDF and quantile as engine-neutral SQL stages.

Neither Spark SQL nor DuckDB has ``erf``; these rational approximations keep the
normal distribution JVM-side (whole-stage codegen) and let the oracle run the very
same formulas.

* ``erfc`` — W. J. Cody's rational Chebyshev approximation (three ranges), as
  published in Math. Comp. 23 (1969) and the public-domain SPECFUN ``CALERF``.
* quantile — P. J. Acklam's rational approximation followed by one Halley step on
  the Cody CDF, which brings it to double precision.
"""

from __future__ import annotations

import math

from propkit.functions.staged import Stages, horner

# Cody's CALERF coefficients (erf on |x| <= 0.46875, erfc on
# 0.46875 < |x| <= 4 and on |x| > 4), in the order the published routine lists them.
CODY_A = [3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02,
          3.20937758913846947e03, 1.85777706184603153e-1]
CODY_B = [2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03,
          2.84423683343917062e03]
CODY_C = [5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01,
          2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03,
          2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8]
CODY_D = [1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02,
          1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03,
          3.43936767414372164e03, 1.23033935480374942e03]
CODY_P = [3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
          1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2]
CODY_Q = [2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1,
          6.05183413124413191e-2, 2.33520497626869185e-3]
SQRPI = 5.6418958354775628695e-1  # 1/sqrt(pi)

# Acklam's inverse-normal coefficients and break point.
ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00]
ACKLAM_PLOW = 0.02425

SQRT2 = math.sqrt(2.0)
SQRT2PI = math.sqrt(2.0 * math.pi)
LN_HALF = math.log(0.5)


def _cody_loop(t: str, lead: float, num: list[float], den: list[float], nloop: int):
    """Numerator/denominator texts of Cody's loop form.

    xnum = lead*t; xden = t; repeat nloop: xnum = (xnum + num[i])*t; xden = (xden + den[i])*t;
    ratio = (xnum + num[nloop]) / (xden + den[nloop]).
    """
    n_coefs = [lead] + num[: nloop + 1]
    d_coefs = [1.0] + den[: nloop + 1]
    return horner(t, n_coefs), horner(t, d_coefs)


def _erfc_ratio_mid(y: str) -> str:
    n, d = _cody_loop(y, CODY_C[8], CODY_C, CODY_D, 7)
    return f"(({n}) / ({d}))"


def _erfc_ratio_tail(y: str) -> str:
    z = f"(1.0 / ({y} * {y}))"
    n, d = _cody_loop(z, CODY_P[5], CODY_P, CODY_Q, 4)
    return f"(({SQRPI!r} - {z} * ({n}) / ({d})) / {y})"


def _erf_small(y: str) -> str:
    t = f"({y} * {y})"
    n, d = _cody_loop(t, CODY_A[4], CODY_A, CODY_B, 3)
    return f"({y} * ({n}) / ({d}))"


def erfc_pos_sql(y: str) -> str:
    """erfc(y) for a column/name ``y`` known to be >= 0."""
    return (
        f"CASE WHEN {y} <= 0.46875 THEN 1.0 - {_erf_small(y)} "
        f"WHEN {y} <= 4.0 THEN exp(-({y} * {y})) * {_erfc_ratio_mid(y)} "
        f"WHEN {y} < 27.0 THEN exp(-({y} * {y})) * {_erfc_ratio_tail(y)} "
        f"ELSE 0.0 END"
    )


def log_erfc_pos_sql(y: str) -> str:
    """ln(erfc(y)) for y >= 0, computed in log space so deep tails do not underflow."""
    return (
        f"CASE WHEN {y} <= 0.46875 THEN ln(1.0 - {_erf_small(y)}) "
        f"WHEN {y} <= 4.0 THEN -({y} * {y}) + ln({_erfc_ratio_mid(y)}) "
        f"ELSE -({y} * {y}) + ln({_erfc_ratio_tail(y)}) END"
    )


def cdf_stages(x: str, out: str) -> Stages:
    """Φ(x) into column ``out``."""
    y = f"_{out}_y"
    e = f"_{out}_e"
    return [
        (y, f"abs({x}) / {SQRT2!r}"),
        (e, erfc_pos_sql(y)),
        (out, f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0 THEN 0.5 * {e} ELSE 1.0 - 0.5 * {e} END"),
    ]


def log_cdf_stages(x: str, out_logcdf: str, out_logsf: str) -> Stages:
    """ln Φ(x) and ln(1 - Φ(x)) into two columns (accurate in both tails)."""
    y = f"_{out_logcdf}_y"
    le = f"_{out_logcdf}_le"
    return [
        (y, f"abs({x}) / {SQRT2!r}"),
        (le, log_erfc_pos_sql(y)),
        # small side: ln(0.5*erfc(y)); large side: ln(1 - 0.5*erfc(y))
        (out_logcdf, f"CASE WHEN {x} < 0 THEN {LN_HALF!r} + {le} ELSE ln(1.0 - 0.5 * exp({le})) END"),
        (out_logsf, f"CASE WHEN {x} > 0 THEN {LN_HALF!r} + {le} ELSE ln(1.0 - 0.5 * exp({le})) END"),
    ]


def ppf_stages(p: str, out: str) -> Stages:
    """Φ⁻¹(p) into ``out`` for p in (0, 1); NULL outside."""
    pl = f"_{out}_pl"
    q = f"_{out}_q"
    x0 = f"_{out}_x0"
    yy = f"_{out}_yy"
    ee = f"_{out}_ee"
    u = f"_{out}_u"
    tail_n = horner(q, ACKLAM_C)
    tail_d = horner(q, ACKLAM_D + [1.0])
    r = f"(({q}) * ({q}))"
    cen_n = horner(r, ACKLAM_A)
    cen_d = horner(r, ACKLAM_B + [1.0])
    return [
        # work on the lower half; the upper half follows by symmetry
        (pl, f"CASE WHEN {p} > 0.5 THEN 1.0 - {p} ELSE {p} END"),
        (q, f"CASE WHEN {pl} < {ACKLAM_PLOW!r} THEN sqrt(-2.0 * ln({pl})) ELSE {pl} - 0.5 END"),
        (x0, f"CASE WHEN {pl} < {ACKLAM_PLOW!r} THEN ({tail_n}) / ({tail_d}) "
             f"ELSE ({cen_n}) * {q} / ({cen_d}) END"),
        # one Halley step on the lower tail, where 0.5*erfc(-x/sqrt2) is accurate
        (yy, f"-{x0} / {SQRT2!r}"),
        (ee, f"0.5 * ({erfc_pos_sql(yy)}) - {pl}"),
        (u, f"{ee} * {SQRT2PI!r} * exp({x0} * {x0} / 2.0)"),
        (out, f"CASE WHEN {p} IS NULL OR {p} <= 0 OR {p} >= 1 THEN NULL "
              f"WHEN {p} > 0.5 THEN -({x0} - {u} / (1.0 + {x0} * {u} / 2.0)) "
              f"ELSE {x0} - {u} / (1.0 + {x0} * {u} / 2.0) END"),
    ]
