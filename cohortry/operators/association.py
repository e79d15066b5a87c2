"""Association tests on aggregated tables (T rows). Counting is distributed; tails run on result rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.numeric import n_if
from .metrics import auc, interval
from .ordered import cumulative, midrank
from .replicates import permuted_auc


def chi2_from_counts(c: DataFrame, by: Sequence[str], a: str, b: str, n: str = "n") -> DataFrame:
    """T1. Chi-square of independence from a long contingency table; Yates correction when df = 1.

    sum (|O-E|-d)^2/E over all cells equals the sum over non-empty cells plus the E of the empty ones; without the
    correction those are N - sum(E over non-empty cells), so absent cells need not be materialised.
    """
    k = list(by)
    tot = c.groupBy(*k).agg(F.sum(n).cast("double").alias("_N"), F.countDistinct(a).alias("_ra"), F.countDistinct(b).alias("_rb"))
    ra = c.groupBy(*k, a).agg(F.sum(n).cast("double").alias("_A"))
    rb = c.groupBy(*k, b).agg(F.sum(n).cast("double").alias("_B"))
    t = c.join(ra, [*k, a]).join(rb, [*k, b]).join(tot, k) if k else None
    if t is None:
        from .ordered import attach_one

        t = attach_one(c.join(ra, a).join(rb, b), tot)
    e = F.col("_A") * F.col("_B") / F.col("_N")
    t = t.withColumn("_e", e).withColumn("_d", F.abs(F.col(n) - e))
    g = t.groupBy(*k).agg(
        F.max("_N").alias("_N"), F.max("_ra").alias("_ra"), F.max("_rb").alias("_rb"), F.sum("_e").alias("_se"),
        F.sum(F.col("_d") * F.col("_d") / F.col("_e")).alias("_plain"), F.max("_d").alias("_dmax"), F.sum(1 / F.col("_e")).alias("_inv"),
        F.count(F.lit(1)).alias("_cells"), F.min(F.col("_A")).alias("_a0"), F.min("_B").alias("_b0"),
    )
    dof = (F.col("_ra") - 1) * (F.col("_rb") - 1)
    plain = F.col("_plain") + F.col("_N") - F.col("_se")
    # 2x2: |O-E| is the same in all four cells, so the corrected sum is (d - min(.5, d))^2 * sum(1/E) over four cells
    a0, b0, N = F.col("_a0"), F.col("_b0"), F.col("_N")
    inv4 = N / (a0 * b0) + N / (a0 * (N - b0)) + N / ((N - a0) * b0) + N / ((N - a0) * (N - b0))
    d = F.col("_dmax")
    yates = (d - F.least(F.lit(0.5), d)) * (d - F.least(F.lit(0.5), d)) * inv4
    return g.select(*k, N.cast("long").alias("n"), dof.cast("long").alias("dof"), F.when(dof == 0, 0.0).when(dof == 1, yates).otherwise(plain).alias("chi2"))


def chi2_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """T1 over rows: NULL keys are dropped."""
    c = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("long").alias("n"))
    return chi2_from_counts(c, [], a, b)


def _tail(x: int, way: int, lo: int, hi: int, ratio) -> float:
    """Sum of p(x), p(x + way), ... to the end of the support, over p(x); stops where the terms vanish. Blocks bound the memory."""
    total, last, block = 0.0, 1.0, 65_536
    while lo <= x <= hi:
        at = np.arange(x, min(hi + 1, x + block) if way > 0 else max(lo - 1, x - block), way, dtype=float)
        terms = last * np.concatenate([[1.0], np.cumprod(ratio(at[:-1]))])
        total += float(terms.sum())
        if terms[-1] < 1e-18 * total:
            break
        last = terms[-1] * float(ratio(at[-1:])[0])
        x = int(at[-1]) + way
    return total


def _fisher(a: float, b: float, c: float, d: float) -> float:
    """Two-sided hypergeometric p: sum of all tables no likelier than the observed one. Sums run outward from the mode and from the two ends of the likelier tables, so
    work follows the width of the distribution and not the table."""
    a, n1, n2, k = int(a), int(a + b), int(c + d), int(a + c)
    lo, hi = max(0, k - n2), min(k, n1)

    def logp(x: int) -> float:
        return -(math.lgamma(x + 1) + math.lgamma(n1 - x + 1) + math.lgamma(k - x + 1) + math.lgamma(n2 - k + x + 1))

    def up(x):
        return (n1 - x) * (k - x) / ((x + 1) * (n2 - k + x + 1))

    def down(x):
        return x * (n2 - k + x) / ((n1 - x + 1) * (k - x + 1))

    mode = min(hi, max(lo, (n1 + 1) * (k + 1) // (n1 + n2 + 2)))
    whole = _tail(mode, 1, lo, hi, up) + _tail(mode - 1, -1, lo, hi, down) * (float(down(mode)) if mode > lo else 0.0)
    bound = logp(a) + 1e-7
    # p is monotone on both sides of the mode: the last x below it, and the first above it, that is no likelier than a
    left, right = lo - 1, mode + 1
    i, j = lo - 1, mode
    while j - i > 1:
        m = (i + j) // 2
        i, j = (m, j) if logp(m) <= bound else (i, m)
    left = i
    i, j = mode - 1 if logp(mode) <= bound else mode, hi + 1
    while j - i > 1:
        m = (i + j) // 2
        i, j = (m, j) if logp(m) > bound else (i, m)
    right = j
    out = 0.0
    if left >= lo:
        out += math.exp(logp(left) - logp(mode)) * _tail(left, -1, lo, hi, down)
    if right <= hi:
        out += math.exp(logp(right) - logp(mode)) * _tail(right, 1, lo, hi, up)
    return min(1.0, out / whole)


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([_fisher(*map(float, t)) for t in zip(a, b, c, d)])


def fisher_exact(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """T2. Four counts per group on Spark; the exact tail on the result rows."""
    one, two = F.col(x), F.col(y)
    g = df.filter(one.isNotNull() & two.isNotNull()).groupBy(*by).agg(
        n_if((one == 1) & (two == 1)).alias("a"), n_if((one == 1) & (two == 0)).alias("b"),
        n_if((one == 0) & (two == 1)).alias("c"), n_if((one == 0) & (two == 0)).alias("d"),
    )
    return g.withColumn("p", fisher_p("a", "b", "c", "d"))


def mann_whitney(df: DataFrame, x: str, g: str, by: Sequence[str] = ()) -> DataFrame:
    """T3. U of group 1, tie-corrected normal z with continuity correction, from compressed counts."""
    cum = cumulative(df.filter(F.col(g).isin(0, 1)), by, x, {"_p": (F.col(g) == 1).cast("double"), "_q": (F.col(g) == 0).cast("double")})
    t = F.col("_p") + F.col("_q")
    s = cum.groupBy(*by).agg(
        F.max("_p_total").alias("n1"), F.max("_q_total").alias("n0"), F.sum(F.col("_p") * (F.col("_q_before") + 0.5 * F.col("_q"))).alias("u"),
        F.sum(t * t * t - t).alias("_tie"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.col("_tie") / (n * (n - 1))))
    dev = F.col("u") - n1 * n0 / 2.0
    z = F.signum(dev) * F.greatest(F.lit(0.0), F.abs(dev) - 0.5) / F.when(sd > 0, sd)
    return s.select(*by, n1.cast("long").alias("n1"), n0.cast("long").alias("n0"), "u", z.alias("z"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """T4. Pearson correlation of mid-ranks over complete pairs."""
    t = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    r = midrank(midrank(t, x, by, "_rx"), y, by, "_ry")
    return r.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("n"), F.corr("_rx", "_ry").alias("rho"))


def auc_envelope(df: DataFrame, x: str, label: str, unit: str, B: int, seed: str) -> DataFrame:
    """T5. Permutation envelope of a single-feature AUC (0.3 % and 99.7 % points) and the beyond-chance flag."""
    env = interval(permuted_auc(df, label, x, unit, B, seed), "auc", [], 0.003, 0.997)
    from .ordered import attach_one

    out = attach_one(auc(df, label, x), env)
    return out.withColumn("beyond_chance", ~F.col("auc").between(F.col("ci_low"), F.col("ci_high")))
