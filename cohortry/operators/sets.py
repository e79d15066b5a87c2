"""Sort, top-k, sampling and set operations (K rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import h60
from .ordered import hash_rank


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """K1. First k rows per group in a total order. Spark prunes inside each partition before the shuffle (group limit)."""
    rn = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rn).filter(F.col("rank") <= k)


def top_k_global(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """K1. Global top-k: per-partition heaps merged, no global sort."""
    return df.orderBy(*order).limit(k)


def sample_units(df: DataFrame, unit: str, n: int, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """K2. Seeded sample without replacement: the n smallest hashes (per group)."""
    h = df.withColumn("_h", h60(unit, F.lit(seed), *by))
    if by:
        return top_k(h, by, ["_h", unit], n).drop("_h", "rank")
    return h.orderBy("_h", unit).limit(n).drop("_h")


def union_relabel(parts: dict[str, DataFrame], out: str = "source") -> DataFrame:
    """K3. Union with a source column."""
    frames = [d.withColumn(out, F.lit(n)) for n, d in parts.items()]
    u = frames[0]
    for d in frames[1:]:
        u = u.unionByName(d, allowMissingColumns=True)
    return u


def unit_set_digest(df: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """K3. Order-free fingerprint of the distinct units per key: count and sum of 60-bit hashes, as text (the sum is a decimal)."""
    d = df.select(*keys, unit).distinct()
    return d.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n_units"), F.sum(h60(unit).cast("decimal(20,0)")).cast("string").alias("digest"))


def same_units(df: DataFrame, arm: str, keys: Sequence[str], unit: str) -> DataFrame:
    """K3. Per key: number of arms and number of different unit sets among them (1 = all arms scored the same units)."""
    d = unit_set_digest(df, [*keys, arm], unit)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n_arms"), F.countDistinct("n_units", "digest").cast("long").alias("n_sets"))


def common_units(a: DataFrame, b: DataFrame, unit: str) -> DataFrame:
    """K4."""
    return a.select(unit).intersect(b.select(unit))


def inconsistent_entities(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """K5 guard: keys whose kept columns are not constant."""
    bad = None
    for c in cols:
        b = ~(F.min(c).eqNullSafe(F.max(c))) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))
        bad = b if bad is None else bad | b
    return df.groupBy(key).agg(bad.alias("_bad"), F.count(F.lit(1)).cast("long").alias("n")).filter("_bad").drop("_bad")


def distinct_entities(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """K5. One row per key (run the guard first: kept columns must be constant, so `max` is that constant)."""
    return df.groupBy(key).agg(*[F.max(c).alias(c) for c in cols])


def eligible_units(df: DataFrame, entity: str, slot: str, length: str, n_slots: int, min_len: float, n: int, slots: Sequence[int]) -> DataFrame:
    """K6. First n entities with every slot and no short recording; their chosen slots only."""
    ok = df.groupBy(entity).agg(F.min(length).alias("_m"), F.countDistinct(slot).alias("_k")).filter((F.col("_m") >= min_len) & (F.col("_k") == n_slots))
    first = ok.select(entity).orderBy(entity).limit(n)
    return df.join(first, entity, "left_semi").filter(F.col(slot).isin(list(slots)))


def blind_codes(df: DataFrame, unit: str, variants: Sequence[str], seed: str) -> DataFrame:
    """K7. Secret key table (unit, variant, letter): codes permuted by hash within each unit. A code has as many letters
    (base 26) as the number of variants needs."""
    t = df.select(unit).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    rn = F.row_number().over(W.partitionBy(unit).orderBy(h60(unit, "variant", F.lit(seed)), "variant"))  # len(variants) rows
    width = 1
    while 26**width < len(variants):
        width += 1
    t = t.withColumn("_rn", rn - 1)
    letters = [F.char(F.pmod(F.floor(F.col("_rn") / 26**d), F.lit(26)) + ord("A")) for d in reversed(range(width))]
    return t.withColumn("letter", F.concat(*letters)).drop("_rn")


def code_table(key: DataFrame, unit: str) -> DataFrame:
    """K7. What the rater sees: codes without the variant."""
    return key.select(unit, "letter", F.concat_ws("-", F.col(unit).cast("string"), "letter").alias("code"))
