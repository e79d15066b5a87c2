"""Resampling: bootstrap draws, permutations, leave-one-out. All draws come from md5 of (replicate, unit, seed)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h60, u01
from ..session import shared
from .ordered import attach_totals, bucketed_prefix, hash_buckets, hash_rank, value_rank


def index_units(df: DataFrame, unit: str, by: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based index of the units in hash order, plus the group size n. One row per unit is expected."""
    u = df.select(*by, unit).withColumn("_h", h60(unit))
    u = bucketed_prefix(hash_buckets(u, "_h"), by, ["_h", unit], {"idx": F.lit(1).cast("long")}, {"idx": "n"})
    return u.select(*by, unit, "idx", "n")


def bootstrap_weights(df: DataFrame, unit: str, B: int, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """R14. Multinomial weights: draw j of replicate b picks unit md5(b, j, seed) mod n. Columns by, unit, b, w (w >= 1).

    One draw row per unit and replicate is made on the fly from the units themselves and counted by (b, index)
    with map-side combine, so nothing larger than the weight table is stored.
    """
    u = shared(index_units(df, unit, by))
    d = u.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B - 1)))).withColumn("pick", h60("b", "idx", F.lit(seed), *by) % F.col("n"))
    w = d.groupBy(*by, "b", F.col("pick").alias("idx")).agg(F.count(F.lit(1)).cast("long").alias("w"))
    return shared(w.join(u.select(*by, "idx", unit), [*by, "idx"]).select(*by, unit, "b", "w"))


def poisson_weights(df: DataFrame, unit: str, B: int, seed: str, by: Sequence[str] = (), steps: Sequence[float] | None = None) -> DataFrame:
    """R14, very large n: Poisson(1) weights by inverse transform of one uniform. Map-only, no shuffle. The weight is the number of `steps` at or below the uniform;
    by default those of the distribution, on to the last one that the uniform's resolution (2^-60) can tell apart."""
    if steps is None:
        steps, p = [], math.exp(-1.0)
        while p > 2.0**-60:
            steps.append((steps[-1] if steps else 0.0) + p)
            p /= len(steps)
    u = df.select(*by, unit).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B - 1)))).withColumn("_u", u01("b", unit, F.lit(seed)))
    w = F.lit(0)
    for x in steps:
        w = w + F.when(F.col("_u") >= F.lit(float(x)), 1).otherwise(0)
    return u.withColumn("w", w.cast("long")).filter("w > 0").select(*by, unit, "b", "w")


def cluster_bootstrap(df: DataFrame, group: str, B: int, seed: str) -> DataFrame:
    """R15. Draw whole groups; every row keeps its group's multiplicity."""
    w = bootstrap_weights(df.select(group).distinct(), group, B, seed)
    return df.join(w, group)


def permute_within(df: DataFrame, unit: str, value: str, by: Sequence[str], B: int, seed: str) -> DataFrame:
    """R16. Permute `value` inside each stratum, B times: rank by key meets rank by hash.

    Columns: by, unit, b, value (the permuted one).
    """
    base = value_rank(df.select(*by, unit, value), by, unit, [], "pos")
    slots = base.select(*by, unit, "pos").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B - 1))))
    src = df.select(*by, unit, value).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B - 1))))
    src = src.withColumn("_h", h60("b", unit, F.lit(seed)))
    src = hash_rank(src, [*by, "b"], "_h", unit, "pos").select(*by, "b", "pos", value)
    return slots.join(src, [*by, "b", "pos"]).select(*by, unit, "b", value)


def leave_one_out(df: DataFrame, group: str, sums: dict) -> DataFrame:
    """R17. Leave-one-group-out replicates of additive statistics: totals minus the group's own part.

    The groups' parts and the totals come from one pass over the data; no replicate is materialised.
    """
    part = df.groupBy(group).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    tot = part.agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    out = attach_totals(part, tot, [])
    return out.select(F.col(group).alias("left_out"), *[(F.col(f"_t_{n}") - F.col(n)).alias(n) for n in sums])
