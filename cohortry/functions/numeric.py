"""Column expressions shared by many operators, and tail probabilities for small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .hashing import col

EPS = 1e-6


def logit(p, eps: float = EPS) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), col(p).cast("double")))
    return F.ln(q / (F.lit(1.0) - q))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def safe_div(a, b) -> Column:
    """NULL on a zero denominator (ANSI mode raises otherwise)."""
    b = col(b).cast("double")
    return F.when(b != 0, col(a).cast("double") / b)


def dsum(c) -> Column:
    return F.sum(col(c).cast("double"))


def r6(c, alias: str | None = None) -> Column:
    out = F.round(col(c).cast("double"), 6)
    return out.alias(alias) if alias else out


def n_if(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


# --- tail probabilities -------------------------------------------------------------------------------------------
# Spark has no erf / incomplete gamma / incomplete beta, so these run as vectorised pandas UDFs on result rows only.

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = math.lgamma


def norm_sf_np(z) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2.0))


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a+1, Lentz continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - _lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction, using the symmetric form where it converges faster."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_i(b, a, 1 - x)
    front = math.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_sf_np(x, k) -> np.ndarray:
    return np.vectorize(lambda v, d: _gamma_q(d / 2.0, v / 2.0) if v == v and d > 0 else np.nan, otypes=[float])(x, k)


def t_sf_np(t, df) -> np.ndarray:
    def one(v, d):
        if v != v or d != d or d <= 0:
            return np.nan
        if math.isinf(v):
            return 0.0 if v > 0 else 1.0
        tail = 0.5 * _beta_i(d / 2.0, 0.5, d / (d + v * v))
        return tail if v >= 0 else 1.0 - tail

    return np.vectorize(one, otypes=[float])(t, df)


def t_ppf_np(q: float, df: float) -> float:
    """Quantile of Student t by bisection on the tail; only ever used for a handful of degrees of freedom."""
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - float(t_sf_np(mid, df)) < q:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def norm_sf(z: pd.Series) -> pd.Series:
    return pd.Series(norm_sf_np(z.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf_np(x.to_numpy(float), k.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_sf_np(t.to_numpy(float), df.to_numpy(float)))
