"""Aggregations (A rows). Overlapping cohorts are one explode and one groupBy, never a loop over filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import col
from ..functions.numeric import logit, n_if, safe_div
from .metrics import auc
from .ordered import attach_one, quantiles


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """A1. Counts with NULL as its own value, and share of all rows."""
    g = df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias("value")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    return attach_one(g, df.agg(F.count(F.lit(1)).alias("_all"))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """A1. Long contingency table with row shares."""
    g = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("long").alias("n"))
    rows = g.groupBy(F.col(a).alias("_k")).agg(F.sum("n").alias("_row"))
    return g.join(rows, F.col(a).eqNullSafe(F.col("_k"))).withColumn("row_share", F.col("n") / F.col("_row")).drop("_row", "_k")


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """A22. Cells, row, column and grand totals from one cube."""
    name = lambda c: F.when(F.grouping(c) == 1, "All").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("<null>")))
    return df.cube(a, b).agg(name(a).alias("_a"), name(b).alias("_b"), F.count(F.lit(1)).cast("long").alias("n")).select(
        F.col("_a").alias(a), F.col("_b").alias(b), "n"
    )


def with_cohorts(df: DataFrame, members: dict[str, Column], out: str = "cohort") -> DataFrame:
    """One row per cohort a unit belongs to (a short, fixed list)."""
    tags = F.filter(F.array(*[F.when(cond, F.lit(n)) for n, cond in members.items()]), lambda x: x.isNotNull())
    return df.withColumn(out, F.explode(tags))


def describe_by(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), probs: dict[str, float] | None = None) -> DataFrame:
    """A2. n, mean, sd, min, max and exact interpolated quantiles for every column, in one pass over long rows."""
    probs = probs or {"q25": 0.25, "median": 0.5, "q75": 0.75}
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(by), list(cols), "variable", "value").filter(F.col("value").isNotNull())
    keys = [*by, "variable"]
    st = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    return quantiles(long, "value", keys, probs).join(st, keys)


def approx_describe_by(df: DataFrame, c: str, by: Sequence[str], probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """A2 by flag: one-pass approximate quantiles for columns with very many distinct values."""
    return df.groupBy(*by).agg(F.percentile_approx(c, list(probs), accuracy).alias("q"))


def day_structure(df: DataFrame, period: Column, label: str) -> DataFrame:
    """A3. Periods with cases only / controls only / both, units on one-sided periods, within-period pairs."""
    g = df.withColumn("_p", period).filter(F.col("_p").isNotNull()).groupBy("_p").agg(n_if(F.col(label) == 1).alias("n1"), n_if(F.col(label) == 0).alias("n0"))
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    return g.agg(
        F.count(F.lit(1)).cast("long").alias("periods"), n_if(F.col("n0") == 0).alias("case_only"), n_if(F.col("n1") == 0).alias("control_only"),
        n_if(both).alias("both"), F.sum(F.when(~both, F.col("n1") + F.col("n0")).otherwise(0)).cast("long").alias("units_one_sided"),
        F.sum(F.col("n1").cast("double") * F.col("n0")).alias("pairs"),
    )


def session_summary(df: DataFrame, entity: str, ts: str, share_of: Column) -> DataFrame:
    """A4. First / last / count of timestamps, start hour, length in minutes, share of rows in a class."""
    g = df.groupBy(entity).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(ts).cast("long").alias("n"), F.avg(share_of.cast("double")).alias("share"))
    minutes = F.timestamp_diff("SECOND", F.col("first_ts"), F.col("last_ts")) / F.lit(60.0)
    return g.withColumn("start_hour", F.hour("first_ts") + F.minute("first_ts") / F.lit(60.0)).withColumn("minutes", minutes)


def mix_signature(df: DataFrame, entity: str, c: str) -> DataFrame:
    """A5. Sorted distinct classes per entity joined by '+', and how many entities share each signature.

    The class column is a small closed set, so the collected set is bounded.
    """
    s = df.groupBy(entity).agg(F.array_join(F.sort_array(F.collect_set(c)), "+").alias("signature"))
    return s.groupBy("signature").agg(F.count(F.lit(1)).cast("long").alias("n"))


def coverage(grid: DataFrame, entity: str) -> DataFrame:
    """A6. OK slots per entity -> distribution."""
    per = grid.groupBy(entity).agg(n_if(F.col("status") == "OK").alias("n_ok"), F.count(F.lit(1)).alias("n_slots"))
    kind = F.when(F.col("n_ok") == F.col("n_slots"), "complete").when(F.col("n_ok") == 0, "none").otherwise("partial")
    return per.groupBy("n_ok", kind.alias("kind")).agg(F.count(F.lit(1)).cast("long").alias("n_entities"))


def missing_by_slot(grid: DataFrame, slot: str) -> DataFrame:
    return grid.groupBy(slot).pivot("status", ["OK", "MISSING", "MULTIPLE"]).agg(F.count(F.lit(1)).cast("long")).na.fill(0)


def slot_flags(grid: DataFrame, entity: str, slot: str, slots: Sequence[int]) -> DataFrame:
    """A6 / R1. One boolean per slot."""
    return grid.groupBy(entity).agg(*[F.bool_or((F.col(slot) == s) & (F.col("status") == "OK")).alias(f"has_{s}") for s in slots])


def date_agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """A7. Same day, within one day, gap quantiles, and how many NULLs of `b` the other date could fill."""
    t = df.select(*by, F.datediff(a, b).alias("delta"), (F.col(b).isNull() & F.col(a).isNotNull()).alias("_fill"))
    q = quantiles(t, "delta", by, {"q05": 0.05, "median": 0.5, "q95": 0.95})
    st = t.groupBy(*by).agg(
        F.avg((F.col("delta") == 0).cast("int")).alias("same_day"), F.avg((F.abs("delta") <= 1).cast("int")).alias("within_1"),
        n_if(F.col("_fill")).alias("filled"),
    )
    return q.join(st, list(by)) if by else attach_one(q, st)


def long_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Value counts of many categorical columns in one shuffle (NULL becomes a category)."""
    t = df.select(*by, *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias(c) for c in cols])
    return t.unpivot(list(by), list(cols), "variable", "value").groupBy("variable", "value", *by).agg(F.count(F.lit(1)).cast("long").alias("n"))


def metadata_screen(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """A8. Per column: distinct values, uniform flag, and the chi-square of value x label (no tail probability)."""
    from .association import chi2_from_counts

    c = long_counts(df.filter(F.col(label).isNotNull()), cols, [label])
    chi = chi2_from_counts(c, ["variable"], "value", label)
    n = c.groupBy("variable", "value").agg(F.sum("n").alias("k")).groupBy("variable").agg(
        F.count(F.lit(1)).cast("long").alias("n_values"), (F.max("k") / F.sum("k")).alias("top_share")
    )
    return n.withColumn("uniform", F.col("n_values") == 1).join(chi, "variable", "left")


def nuisance_screen(df: DataFrame, feats: Sequence[str], y: str, by: Sequence[str], k: int = 15, min_n: int = 10) -> DataFrame:
    """A9. AUC of every numeric feature per group, ranked by |AUC - 0.5|; the screen reports the top k."""
    long = df.select(*by, y, *[F.col(f).cast("double").alias(f) for f in feats]).unpivot([*by, y], list(feats), "feature", "value").filter(F.col("value").isNotNull())
    a = auc(long, y, "value", [*by, "feature"]).filter((F.col("n1") + F.col("n0") >= min_n) & F.col("auc").isNotNull())
    a = a.withColumn("strength", F.round(F.abs(F.col("auc") - 0.5), 9))
    top = a.orderBy(F.desc("strength"), *by, "feature").limit(k)
    return top


def fuse(preds: DataFrame, keys: Sequence[str], reference: Column | None = None) -> DataFrame:
    """A10. Late fusion: mean probability over slots; rows of reference arms are relabelled, not averaged."""
    a = preds if reference is None else preds.filter(~reference)
    out = a.groupBy(*keys).agg(F.avg("prob").alias("prob")).withColumn("task", F.lit("fusion"))
    if reference is not None:
        out = out.unionByName(preds.filter(reference).select(*keys, "prob").withColumn("task", F.lit("fusion")))
    return out


def pool(preds: DataFrame, keys: Sequence[str], repeat: str = "repeat", on: str = "prob") -> DataFrame:
    """A11. slots -> (logit) -> repeats."""
    per = preds.groupBy(*keys, repeat).agg(F.avg("prob").alias("prob"))
    v = F.col("prob") if on == "prob" else logit("prob")
    return per.groupBy(*keys).agg(F.avg(v).alias("score"))


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """A12. Element-wise mean vector per key, long in between so no group is gathered; dimension count is fixed."""
    long = df.select(*keys, F.posexplode(vec).alias("pos", "x"))
    m = long.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_v")).select(*keys, F.transform("_v", lambda s: s["x"]).alias("vec"))


def non_finite(df: DataFrame, vec: str) -> DataFrame:
    """A12 guard: vectors with a NaN or infinite entry."""
    bad = F.exists(vec, lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")) | x.isNull())
    return df.filter(bad)


def layer_average(long: DataFrame, keys: Sequence[str], train: str, layer: str = "layer", dim: str = "dim", x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """A13. z-score each (layer, dim) on the training rows only, then average the layers."""
    st = long.filter(F.col(train)).groupBy(*by, layer, dim).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    z = (F.col(x) - F.col("_m")) / F.when(F.col("_s") < 1e-8, 1.0).otherwise(F.col("_s"))
    return long.join(st, [*by, layer, dim]).groupBy(*keys, *[b for b in by if b not in keys], dim).agg(F.avg(z).alias("x"))


def center_vectors(df: DataFrame, vec: str, out: str = "shape") -> DataFrame:
    """A14. Subtract the row mean."""
    t = df.withColumn("_m", F.aggregate(vec, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(vec))
    return t.withColumn(out, F.transform(vec, lambda v: v.cast("double") - F.col("_m"))).drop("_m")


def feature_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], feats: Sequence[str]) -> DataFrame:
    """A15. Pearson r of every feature between two extraction routes (one wide join, one pass)."""
    j = a.select(*keys, *[F.col(f).alias(f"_a_{f}") for f in feats]).join(b.select(*keys, *[F.col(f).alias(f"_b_{f}") for f in feats]), list(keys))
    rows = j.agg(*[F.corr(f"_a_{f}", f"_b_{f}").alias(f) for f in feats]).unpivot([], list(feats), "feature", "r")
    return rows


def inclusion_funnel(df: DataFrame, variants: dict[str, Column], group: str, limit: float) -> DataFrame:
    """A16. Included / n per variant and group, gap in percentage points, gap flag."""
    t = df.select(group, F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), c.cast("double").alias("inc")) for n, c in variants.items()])).alias("v"))
    g = t.groupBy(F.col("v.variant").alias("variant"), group).agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum("v.inc").cast("long").alias("included"), (100 * F.avg("v.inc")).alias("pct"))
    gap = g.groupBy("variant").agg((F.max("pct") - F.min("pct")).alias("gap_pp"))
    return g.join(gap, "variant").withColumn("flag", F.col("gap_pp") > limit)


def duration_profile(df: DataFrame, dur: str, by: Sequence[str], short: float) -> DataFrame:
    """A17. Quartiles and number of short recordings per group."""
    q = quantiles(df, dur, by, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return q.join(df.groupBy(*by).agg(n_if(F.col(dur) < short).alias("n_short")), list(by))


def rating_gate(sheet: DataFrame, key: DataFrame, code: str, variant: str, rating: str, limits: dict[str, float]) -> DataFrame:
    """A18. Blinded ratings joined to their secret key: mean, share >= 1 and pass / fail against the variant's limit."""
    t = sheet.join(key, code)
    g = t.groupBy(variant).agg(F.count(rating).cast("long").alias("n"), F.avg(rating).alias("mean"), F.avg((F.col(rating) >= 1).cast("double")).alias("share_ge1"))
    lim = F.coalesce(*[F.when(F.col(variant) == v, F.lit(float(x))) for v, x in limits.items()])
    return g.withColumn("limit", lim).withColumn("passed", F.col("share_ge1") <= F.col("limit"))


def decompose(df: DataFrame, task: str, protocol: str, source: str, value: str, protocols: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """A19. Protocol x input routes pivoted to columns per task, with the effect of each factor."""
    aggs = [F.avg(F.when((F.col(protocol) == p) & (F.col(source) == s), F.col(value))).alias(f"{p}_{s}") for p in protocols for s in sources]
    g = df.groupBy(task).agg(*aggs)
    (p0, p1), (s0, s1) = protocols, sources
    c = lambda p, s: F.col(f"{p}_{s}")
    return g.withColumns({
        "protocol_effect": (c(p1, s0) - c(p0, s0) + c(p1, s1) - c(p0, s1)) / 2,
        "source_effect": (c(p0, s1) - c(p0, s0) + c(p1, s1) - c(p1, s0)) / 2,
    })


def reproduction_gap(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A19. Largest absolute difference between two stored result tables."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys))
    return j.agg(F.count(F.lit(1)).cast("long").alias("n"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs"))


def seed_luck(df: DataFrame, by: Sequence[str], seed: str, ref_seed, value: str) -> DataFrame:
    """A20. Distribution over split seeds and the percentile of one of them."""
    ref = df.filter(F.col(seed) == ref_seed).groupBy(*by).agg(F.max(value).alias("ref"))
    return df.join(ref, list(by)).groupBy(*by).agg(
        F.count(value).cast("long").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"),
        (100 * F.avg((F.col(value) < F.col("ref")).cast("double"))).alias("ref_percentile"),
    )


def run_summary(df: DataFrame, arm: str, value: str) -> DataFrame:
    """A21."""
    return df.groupBy(arm).agg(F.count(value).cast("long").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.sum(value).alias("sum"))


def pivot_mean(df: DataFrame, rows: Sequence[str], cols: str, values: Sequence, value: str) -> DataFrame:
    """A23. Mean by row key x column key, fixed column order, one aggregation."""
    return df.groupBy(*rows).agg(*[F.avg(F.when(F.col(cols) == v, F.col(value))).alias(str(v)) for v in values])


def roll_up_scores(df: DataFrame, window_keys: Sequence[str], entity_keys: Sequence[str], p: str) -> DataFrame:
    """A24. Window -> recording -> entity mean on the logit scale, counting non-finite windows on the way."""
    bad = F.col(p).isNull() | F.isnan(F.col(p).cast("double"))
    rec = df.groupBy(*window_keys).agg(F.avg(F.when(~bad, logit(p))).alias("_l"), n_if(bad).alias("_b"))
    return rec.groupBy(*entity_keys).agg(F.avg("_l").alias("logit"), F.count(F.lit(1)).cast("long").alias("n_recordings"), F.sum("_b").cast("long").alias("n_bad"))
