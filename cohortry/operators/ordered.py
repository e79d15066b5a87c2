"""Ordered analytics without a single-task sort: prefix sums, mid-ranks, exact quantiles and row numbers.

A window over an unbounded group puts the whole group into one task. Everything here first slices the order into
buckets, runs the window inside (group, bucket), and adds the totals of the earlier buckets. Totals are
groups x buckets rows, so the only whole-group window runs over at most `buckets` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import TWO60
from ..session import bucket_count

BUCKET = "_bucket"


def _uses_all(cols: Sequence[str]) -> Column:
    """A true condition that reads every measure. Column pruning then leaves all branches over one compressed
    table identical, so Spark computes that exchange once and reuses it."""
    named = [F.col(c).cast("double") for c in cols]
    return (F.greatest(*named) if len(named) > 1 else named[0]).isNotNull()


def _as_number(df: DataFrame, x: str) -> Column:
    """A double that is monotone in x, also for dates, timestamps and strings (first six bytes). Keys it does not tell apart share a
    bucket, inside which the window orders by the key itself."""
    kind = dict(df.dtypes)[x]
    c = F.col(x)
    if kind == "date":
        c = F.unix_date(c)
    elif kind.startswith("timestamp"):
        c = F.unix_micros(c.cast("timestamp"))
    elif kind in ("string", "binary"):
        raw = c if kind == "binary" else F.encode(c, "UTF-8")
        c = F.conv(F.hex(F.substring(F.rpad(raw, 6, F.unhex(F.lit("00"))), 1, 6)), 16, 10)
    return c.cast("double")


def value_buckets(df: DataFrame, x: str, buckets: int | None = None, measures: Sequence[str] = ()) -> DataFrame:
    """Add a bucket number that is monotone in x and roughly balanced.

    Edges come from one approximate-percentile scalar subquery; the bucket is found by an unrolled binary search
    (log2(buckets) comparisons per row, inside codegen). The result of the prefix sums does not depend on the edges.
    """
    n = buckets or bucket_count(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    src = df.filter(_uses_all(measures)) if measures else df
    number = _as_number(df, x)
    edges = src.agg(F.percentile_approx(number, probs, max(10_000, 8 * n)).alias("e")).scalar()
    out = df.withColumn("_edges", edges).withColumn(BUCKET, F.lit(0))
    step = n // 2
    while step >= 1:
        edge = F.col("_edges")[F.col(BUCKET) + F.lit(step - 1)]
        out = out.withColumn(BUCKET, F.when(number > edge, F.col(BUCKET) + F.lit(step)).otherwise(F.col(BUCKET)))
        step //= 2
    return out.drop("_edges")


def hash_buckets(df: DataFrame, h: str, buckets: int | None = None) -> DataFrame:
    """Bucket for a 60-bit hash: uniform by construction, so no edges are needed."""
    n = buckets or bucket_count(df.sparkSession)
    return df.withColumn(BUCKET, F.floor(F.col(h) * F.lit(n / TWO60)).cast("int"))


def bucketed_prefix(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column],
                    totals: dict[str, str] | None = None) -> DataFrame:
    """Exclusive prefix sums over rows that already carry BUCKET (monotone in `order` within each group).

    Adds one column per entry of `sums`: the sum over all earlier rows of the group. `totals` maps entries of `sums` to
    the name of a column for the group's grand total, which the offsets window yields for free. `by` must be free of NULLs.
    """
    keys = [*by, BUCKET]
    vals = df
    for name, c in sums.items():
        vals = vals.withColumn(f"_v_{name}", c)
    part = vals.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    group = W.partitionBy(*by)
    before = group.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = part.filter(_uses_all([f"_t_{n}" for n in sums])).select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(group).alias(out) for n, out in (totals or {}).items()],
    )
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = vals.join(offsets, keys)
    return out.select(
        *df.columns,
        *[(F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) + F.col(f"_o_{n}")).alias(n) for n in sums],
        *(totals or {}).values(),
    )


def compress(df: DataFrame, by: Sequence[str], x: str, sums: dict[str, Column]) -> DataFrame:
    """One row per (group, distinct value) with summed measures: ties and hot values collapse before any ordering."""
    return df.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(*by, x).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()]
    )


def cumulative(df: DataFrame, by: Sequence[str], x: str, sums: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """compress + exclusive prefix: columns by, x, each measure, `<measure>_before` and `<measure>_total`."""
    comp = compress(df, by, x, sums)
    return bucketed_prefix(
        value_buckets(comp, x, buckets, list(sums)), by, [x], {f"{n}_before": F.col(n) for n in sums},
        {f"{n}_before": f"{n}_total" for n in sums},
    ).drop(BUCKET)


def midrank(df: DataFrame, x: str, by: Sequence[str] = (), out: str = "rank", buckets: int | None = None) -> DataFrame:
    """W1. Mid-rank within group (ties share the average rank), joined back by value."""
    ranks = cumulative(df, by, x, {"_n": F.lit(1).cast("long")}, buckets).select(
        *by, x, (F.col("_n_before") + (F.col("_n") + 1) / F.lit(2.0)).alias(out)
    )
    return df.join(ranks, [*by, x])


def quantiles(df: DataFrame, x: str, by: Sequence[str], probs: dict[str, float], weight: Column | None = None,
              buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group, from value counts instead of an in-memory group."""
    cum = cumulative(df, by, x, {"_n": (weight if weight is not None else F.lit(1)).cast("long")}, buckets)
    hi_end = F.col("_n_before") + F.col("_n")
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n_total") - 1) * F.lit(float(p))
        for side, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((F.col("_n_before") <= k) & (k < hi_end), F.col(x).cast("double"))).alias(f"_{name}_{side}"))
    g = cum.groupBy(*by).agg(F.sum("_n").alias("n"), *aggs)
    res = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        between = F.col(f"_{name}_lo") * (1 - frac) + F.col(f"_{name}_hi") * frac
        apart = (frac > 0) & (F.col(f"_{name}_lo") != F.col(f"_{name}_hi"))  # an infinite neighbour times 0 would be NaN; the shares of one value can add up to less than it
        res.append(F.when(apart, between).otherwise(F.col(f"_{name}_lo")).alias(name))
    return g.select(*by, "n", *res)


def hash_rank(df: DataFrame, by: Sequence[str], h: str, tie: str, out: str = "rn", buckets: int | None = None) -> DataFrame:
    """1-based row number within group in (hash, tie) order: the seeded shuffle of splits, draws and samples."""
    ranked = bucketed_prefix(hash_buckets(df, h, buckets), by, [h, tie], {out: F.lit(1).cast("long")})
    return ranked.withColumn(out, F.col(out) + 1).drop(BUCKET)


def value_rank(df: DataFrame, by: Sequence[str], x: str, tie: Sequence[str], out: str = "rn", buckets: int | None = None) -> DataFrame:
    """1-based row number within group in (x, tie) order. Use where x has no unbounded ties (keys, times)."""
    ranked = bucketed_prefix(value_buckets(df, x, buckets), by, [x, *tie], {out: F.lit(1).cast("long")})
    return ranked.withColumn(out, F.col(out) + 1).drop(BUCKET)


def halo(df: DataFrame, t: str, before: int, after: int, size: int, chunk: str = "_chunk", own: str = "_own") -> DataFrame:
    """Cut an integer time axis into chunks of `size`, copying rows into the neighbour chunks their window reaches.

    A frame window then runs inside (series, chunk), so a single long series spreads over many tasks.
    """
    first = F.floor((F.col(t) - F.lit(after)) / F.lit(size)).cast("long")
    last = F.floor((F.col(t) + F.lit(before)) / F.lit(size)).cast("long")
    return df.withColumn(chunk, F.explode(F.sequence(first, last))).withColumn(
        own, F.col(chunk) == F.floor(F.col(t) / F.lit(size)).cast("long")
    )


def frame_window(df: DataFrame, by: Sequence[str], t: str, before: int, after: int, exprs: dict, size: int = 100_000) -> DataFrame:
    """Evaluate `exprs[name](window)` over t-before..t+after (inclusive) for every row, chunk by chunk.

    An expression may narrow the frame with its own rangeBetween.
    """
    h = halo(df, t, before, after, size)
    w = W.partitionBy(*by, "_chunk").orderBy(t).rangeBetween(-before, after)
    return h.select("*", *[fn(w).alias(n) for n, fn in exprs.items()]).filter("_own").drop("_chunk", "_own")


def attach_one(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row through a scalar subquery (no join)."""
    cols = one.columns
    s = one.select(F.struct(*cols).alias("s")).scalar()
    return df.withColumn("_one", s).select(*[F.col(c) for c in df.columns], *[F.col("_one")[c].alias(c) for c in cols])


def attach_totals(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(totals, list(by)) if by else attach_one(df, totals)
