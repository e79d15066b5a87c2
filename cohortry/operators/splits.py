"""Cohorts, strata, folds and their integrity checks (R rows). Seeds: outer r, inner 1000 + 10 r + k, fed to md5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import h60, u01
from ..functions.numeric import n_if
from ..session import shared
from .joins import key_diff
from .metricspace import k_nearest
from .ordered import attach_one, attach_totals, hash_rank
from .profile import slot_flags
from .resample import index_units


def build_cohort(ctx: DataFrame, grid: DataFrame, entity: str, slot: str, slots: Sequence[int]) -> DataFrame:
    """R1. Units with at least one OK recording, with one flag per slot."""
    flags = slot_flags(grid, entity, slot, slots)
    any_ok = F.lit(False)
    for s in slots:
        any_ok = any_ok | F.col(f"has_{s}")
    return ctx.join(flags.filter(any_ok), entity)


def cohort_guard(ctx: DataFrame, grid: DataFrame, entity: str, label: str) -> DataFrame:
    """R1 guards as rows: duplicate ids, labels outside 0/1, recordings of unknown ids."""
    dup = ctx.groupBy(entity).agg(F.count(F.lit(1)).alias("k")).agg(F.lit("duplicate_id").alias("check"), n_if(F.col("k") > 1).alias("n"))
    dom = ctx.agg(F.lit("label_domain").alias("check"), n_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("n"))
    unk = grid.filter("status = 'OK'").select(entity).distinct().join(ctx.select(entity), entity, "left_anti")
    return dup.unionByName(dom).unionByName(unk.agg(F.lit("unknown_id").alias("check"), F.count(F.lit(1)).cast("long").alias("n")))


def stratum_key(label: str, phase: str, age_group: str):
    return F.concat_ws("|", F.col(label).cast("string"), F.col(phase), F.col(age_group))


def age_group(age: str, cut: float):
    return F.when(F.col(age).isNull(), "unknown").when(F.col(age) <= cut, "young").otherwise("old")


def merge_plan(df: DataFrame, key: str, min_size: int = 5) -> DataFrame:
    """R2 log. Strata below min_size and the originally big stratum each joins: same label + phase first, then same label,
    the largest, ties by key. Works on the table of strata (label x phase x age group)."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).cast("long").alias("n"))
    part = n.select("*", F.split(key, r"\|")[0].alias("_l"), F.split(key, r"\|")[1].alias("_p"))
    small = part.filter(F.col("n") < min_size)
    big = part.filter(F.col("n") >= min_size).select(F.col(key).alias("merged_into"), F.col("n").alias("_bn"), "_l", F.col("_p").alias("_bp"))
    j = small.join(big, "_l", "left")
    order = W.partitionBy(key).orderBy(F.desc(F.col("_p") == F.col("_bp")), F.desc("_bn"), "merged_into")
    return j.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").select(key, "n", "merged_into")


def _stop(message: str, c: str):
    return F.raise_error(F.concat(F.lit(message), F.coalesce(F.col(c).cast("string"), F.lit("a null key")))).cast("string")


def assign_strata(df: DataFrame, key: str, min_size: int = 5, out: str = "strata") -> DataFrame:
    """R2. Remap small strata. A small stratum without any compatible big one stops the job: its units would drop out of every fold."""
    plan = merge_plan(df, key, min_size).select(key, F.col("merged_into").alias("_to"), F.lit(True).alias("_small"))
    return df.join(plan, key, "left").withColumn(out, F.when(F.col("_small"), F.coalesce("_to", _stop("no stratum to join for ", key))).otherwise(F.col(key))).drop("_to", "_small")


def stratified_folds(df: DataFrame, unit: str, strata: str, k: int, repeats: int, shuffle: bool = True, out: str = "outer_fold") -> DataFrame:
    """R3. Each unit tested once per repeat; inside a stratum the fold sizes differ by at most one.

    Unshuffled: units in key order. The start fold rotates by stratum so small strata do not all load fold 0.
    """
    t = df.select(unit, F.coalesce(F.col(strata).cast("string"), _stop("no stratum for unit ", unit)).cast(dict(df.dtypes)[strata]).alias(strata)).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    t = t.withColumn("_h", h60(unit, F.col("repeat")) if shuffle else F.lit(0).cast("long"))
    if shuffle:
        t = hash_rank(t, ["repeat", strata], "_h", unit, "_rn")
    else:
        from .ordered import value_rank

        t = value_rank(t, ["repeat", strata], unit, [], "_rn")
    start = h60(strata, F.col("repeat"), F.lit("start")) % k
    return t.select(unit, strata, F.col("repeat").cast("long").alias("repeat"), ((F.col("_rn") - 1 + start) % k).cast("long").alias(out))


def nested_splits(df: DataFrame, unit: str, strata: str, k: int, repeats: int) -> DataFrame:
    """R4. (unit, repeat, outer_fold) -> role, inner_fold (-1 for test), is_inner_val."""
    outer = shared(stratified_folds(df, unit, strata, k, repeats, out="own"))
    t = outer.withColumn("outer_fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    keys = ["unit_", "repeat", "outer_fold"]
    t = t.withColumnRenamed(unit, "unit_")
    seed = 1000 + 10 * F.col("repeat") + F.col("outer_fold")
    train = t.filter("own <> outer_fold").withColumn("_h", h60("unit_", seed))
    train = hash_rank(train, ["repeat", "outer_fold", strata], "_h", "unit_", "_rn")
    start = h60(strata, seed, F.lit("start")) % k
    train = train.select(*keys, strata, F.lit("train").alias("role"), ((F.col("_rn") - 1 + start) % k).cast("long").alias("inner_fold"))
    test = t.filter("own = outer_fold").select(*keys, strata, F.lit("test").alias("role"), F.lit(-1).cast("long").alias("inner_fold"))
    out = train.unionByName(test).withColumnRenamed("unit_", unit)
    return out.withColumn("is_inner_val", (F.col("role") == "train") & (F.col("inner_fold") == 0))


def day_groups(day: str, unit: str):
    """R6. Group key from a date; a NULL date is its own group."""
    return F.coalesce(F.col(day).cast("string"), F.concat(F.lit("nodate_"), F.col(unit).cast("string")))


def fold_quotas(profiles: Sequence[tuple[int, int, int]], k: int) -> list[list[int]]:
    """Groups of each profile (n0, n1, number of groups) per fold: largest first, each group to the fold where the sum of squared shares of the class
    totals grows least, ties to the lower fold.

    Equal groups need no loop: every further one raises the fold's growth by the same amount, so the c smallest terms of k arithmetic progressions are
    taken at once. Growth is compared in whole numbers (over the squared totals).
    """
    t0, t1 = (max(1, sum(p[i] * p[2] for p in profiles)) for i in (0, 1))
    held = [[0, 0] for _ in range(k)]
    out = []
    for n0, n1, c in profiles:
        at = [h[0] * n0 * t1 * t1 + h[1] * n1 * t0 * t0 for h in held]
        d = n0 * n0 * t1 * t1 + n1 * n1 * t0 * t0
        if d == 0:
            got = [c // k + (f < c % k) for f in range(k)]
        else:
            def below(level: int, at=at, d=d) -> list[int]:
                """Terms per fold that are at most `level`."""
                return [max(0, (level - g) // d + 1) for g in at]

            lo, hi = min(at) - 1, min(at) + d * c
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if sum(below(mid)) >= c else (mid, hi)
            got, full = below(lo), below(hi)
            rest = c - sum(got)
            for f in range(k):
                if rest and full[f] > got[f]:
                    got[f] += 1
                    rest -= 1
        for f in range(k):
            held[f][0] += n0 * got[f]
            held[f][1] += n1 * got[f]
        out.append(got)
    return out


def grouped_folds(df: DataFrame, group: str, label: str, k: int, seeds: Sequence[int]) -> DataFrame:
    """R5. Whole groups to folds, balanced by class: (group, seed, fold).

    Groups with the same class counts are interchangeable, so the greedy rule runs on the table of distinct profiles (n0, n1, groups), which is all the driver sees;
    inside a profile the groups are dealt by hash rank. One rule for every size.
    """
    g = shared(df.groupBy(group).agg(n_if(F.col(label) == 0).alias("n0"), n_if(F.col(label) == 1).alias("n1")))
    found = g.groupBy("n0", "n1").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc(F.col("n0") + F.col("n1")), F.desc("n0")).collect()  # one row per profile
    profiles = [(r["n0"], r["n1"], r["c"]) for r in found]
    bounds = []
    for (n0, n1, _), quota in zip(profiles, fold_quotas(profiles, k), strict=True):
        total, upto = 0, []
        for q in quota:
            total += q
            upto.append(total)
        bounds.append((n0, n1, upto))
    table = df.sparkSession.createDataFrame(bounds, "n0 long, n1 long, upto array<long>")
    s = g.withColumn("seed", F.explode(F.lit([int(x) for x in seeds]).cast("array<long>"))).withColumn("_h", h60(group, "seed"))
    ranked = hash_rank(s, ["seed", "n0", "n1"], "_h", group, "_rn").join(table, ["n0", "n1"])
    return ranked.select(group, "seed", F.size(F.filter("upto", lambda u: u < F.col("_rn"))).cast("long").alias("fold"))


def grouped_nested_splits(df: DataFrame, unit: str, group: str, label: str, k: int, repeat: int) -> DataFrame:
    """R5 applied twice: outer folds by group, inner folds of every training part by group."""
    base = df.select(unit, group, label)
    outer = grouped_folds(base, group, label, k, [repeat]).select(group, F.col("fold").alias("own"))
    outer = shared(base.join(outer, group))
    parts = []
    for f in range(k):  # k is the number of folds (5)
        tr = outer.filter(F.col("own") != f)
        inner = grouped_folds(tr, group, label, k, [1000 + 10 * repeat + f]).select(group, F.col("fold").alias("inner_fold"))
        role = F.when(F.col("own") == f, "test").otherwise("train")
        parts.append(outer.join(inner, group, "left").select(
            unit, group, label, F.lit(repeat).cast("long").alias("repeat"), F.lit(f).cast("long").alias("outer_fold"), role.alias("role"),
            F.when(F.col("own") == f, F.lit(-1)).otherwise(F.col("inner_fold")).cast("long").alias("inner_fold")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stratified_group_folds(df: DataFrame, entity: str, label: str, k: int, seed: int) -> DataFrame:
    """R18. Entity kept whole, recording-level labels balanced."""
    return grouped_folds(df, entity, label, k, [seed]).select(entity, "fold")


def check_splits(splits: DataFrame, cohort: DataFrame, unit: str, label: str, k: int, group: str | None = None) -> DataFrame:
    """R7. Violation counts per (check, repeat, fold) for one table of nested splits; all zero = pass.

    `splits` has unit, repeat, outer_fold, role, inner_fold. `cohort` has unit, label and, if given, group.
    """
    attrs = cohort.select(unit, label, *([group] if group else []))
    s = shared(splits.select(unit, "repeat", "outer_fold", "role", "inner_fold").join(attrs, unit, "left"))
    out = []

    def add(name, df, n, fold="outer_fold"):
        out.append(df.select(F.lit(name).alias("check"), "repeat", (F.col(fold) if fold else F.lit(None)).cast("long").alias("fold"), n.cast("long").alias("n")))

    tested = s.groupBy("repeat", unit).agg(n_if(F.col("role") == "test").alias("t"), F.countDistinct("outer_fold").alias("f"), F.count(F.lit(1)).alias("r"))
    g = tested.groupBy("repeat").agg(n_if(F.col("t") != 1).alias("bad_t"), n_if((F.col("f") != k) | (F.col("r") != k)).alias("bad_f"), F.count(F.lit(1)).alias("n_u"))
    add("tested_once", g, F.col("bad_t"), None)
    add("one_role_per_fold", g, F.col("bad_f"), None)
    add("covers_cohort", attach_one(g, attrs.agg(F.count(F.lit(1)).alias("n_all"))), F.abs(F.col("n_all") - F.col("n_u")), None)
    per = s.groupBy("repeat", "outer_fold").agg(
        n_if((F.col("role") == "train") & ~F.coalesce(F.col("inner_fold").between(0, k - 1), F.lit(False))).alias("bad_train"),
        n_if((F.col("role") == "test") & (F.col("inner_fold") != -1)).alias("bad_test"), n_if(F.col(label) == 0).alias("h"),
        n_if((F.col("role") == "test") & (F.col(label) == 0)).alias("h_test"),
        n_if((F.col("role") == "train") & (F.col(label) == 0)).alias("h_tr"),
        n_if((F.col("role") == "train") & (F.col("inner_fold") == 0) & (F.col(label) == 0)).alias("h_val"),
    )
    per = per.withColumns({"e_test": F.col("h") / k, "e_val": F.col("h_tr") / k})
    add("inner_folds_valid", per, F.col("bad_train") + F.col("bad_test"))

    def off(c, e):
        if group:
            return F.abs(F.col(c) - F.col(e)) > F.greatest(F.lit(1.5), 0.5 * F.col(e))
        return ~F.col(c).between(F.floor(e) - 1, F.ceil(e) + 1)

    add("controls_balanced", per, (off("h_test", "e_test") | off("h_val", "e_val") | (F.col("h_val") < 1)).cast("int"))
    if group:
        both = s.groupBy("repeat", "outer_fold", group).agg(F.countDistinct("role").alias("k"), F.countDistinct(F.when(F.col("role") == "train", F.col("inner_fold"))).alias("i"))
        gg = both.groupBy("repeat", "outer_fold").agg(n_if(F.col("k") > 1).alias("outer_leak"), n_if(F.col("i") > 1).alias("inner_leak"))
        add("group_on_both_sides", gg, F.col("outer_leak"))
        add("group_in_two_inner_folds", gg, F.col("inner_leak"))
    res = out[0]
    for d in out[1:]:
        res = res.unionByName(d)
    return res


def split_summary(splits: DataFrame, cohort: DataFrame, unit: str, flags: dict) -> DataFrame:
    """R8. Per fold and role: unit count and the count of every flag expression."""
    return splits.join(cohort, unit).groupBy("repeat", "outer_fold", "role").agg(
        F.count(F.lit(1)).cast("long").alias("n"), *[n_if(c).alias(n) for n, c in flags.items()]
    )


def changed_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """R9. Rows of either table missing in the other (with multiplicity). Empty = deterministic."""
    cols = a.columns
    return a.exceptAll(b.select(*cols)).unionByName(b.select(*cols).exceptAll(a))


def class_weights(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """R10. Balanced weights n / (2 n_c) and the positive weight n0 / n1."""
    g = df.groupBy(*by).agg(n_if(F.col(label) == 1).alias("n1"), n_if(F.col(label) == 0).alias("n0"))
    n = (F.col("n1") + F.col("n0")).cast("double")
    return g.withColumns({"w1": F.when(F.col("n1") > 0, n / (2 * F.col("n1"))), "w0": F.when(F.col("n0") > 0, n / (2 * F.col("n0"))),
                          "pos_weight": F.when(F.col("n1") > 0, F.col("n0") / F.col("n1"))})


def ipw(df: DataFrame, cell: Sequence[str], label: str, by: Sequence[str] = (), out: str = "w") -> DataFrame:
    """R11. 1 / p(label | cell), divided by the mean weight. Cell shares are a small table joined back."""
    keys = [*by, *cell]
    p = df.groupBy(*keys).agg(F.avg(label).alias("_p"), F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_k"))
    # mean weight from the cell table: each class that occurs in a cell contributes (class count) / share = cell size
    mean = p.groupBy(*by).agg((F.sum(F.col("_n") * ((F.col("_k") > 0).cast("int") + (F.col("_k") < F.col("_n")).cast("int"))) / F.sum("_n")).alias("_mw"))
    t = attach_totals(p, mean, by).drop("_n", "_k")
    share = F.when(F.col(label) == 1, F.col("_p")).otherwise(1 - F.col("_p"))
    return df.join(t, keys).withColumn(out, F.when(share > 0, 1 / share).otherwise(0.0) / F.col("_mw")).drop("_p", "_mw")


def _deficit_draws(df: DataFrame, unit: str, label: str, by: Sequence[str], seed: str) -> tuple[DataFrame, DataFrame]:
    """Draw slots (by, j, n_min) — one per missing minority row, carried by majority rows so they are spread — and the
    indexed minority rows (by, idx, unit)."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c"))
    t = n.groupBy(*by).agg(F.min("_c").alias("n_min"), F.max("_c").alias("n_max"), F.min_by(label, F.struct("_c", label)).alias("minority"), F.count(F.lit(1)).alias("_k"))
    t = t.filter("_k = 2")
    idx = shared(attach_totals(index_units(df, unit, [*by, label]).drop("n"), t, by))
    slots = idx.filter((F.col(label) != F.col("minority")) & (F.col("idx") < F.col("n_max") - F.col("n_min"))).select(*by, F.col("idx").alias("j"), "n_min")
    return slots, idx.filter(F.col(label) == F.col("minority")).select(*by, "idx", unit)


def oversample(df: DataFrame, unit: str, label: str, by: Sequence[str], seed: str) -> DataFrame:
    """R12. Minority rows drawn with replacement until both classes are equal: (by, unit, j) of the extra rows."""
    slots, minority = _deficit_draws(df, unit, label, by, seed)
    pick = slots.withColumn("idx", h60("j", F.lit(seed), *by) % F.col("n_min"))
    return pick.join(minority, [*by, "idx"]).select(*by, unit, "j")


def smote(df: DataFrame, unit: str, vec: str, label: str, by: Sequence[str], seed: str, k: int = 5) -> DataFrame:
    """R13. Synthetic minority rows between a minority row and one of its k = min(5, n-1) nearest minority neighbours.

    Groups with fewer than two minority rows, or already balanced, add nothing. Output: by, j, unit, nb, lam, vec.
    """
    slots, minority = _deficit_draws(df, unit, label, by, seed)
    slots = slots.filter("n_min >= 2")
    vecs = shared(minority.join(df.select(*by, unit, vec), [*by, unit]))
    nn = k_nearest(vecs, vecs, unit, vec, k, by)
    s = slots.withColumns({"idx": h60("j", F.lit(seed), *by) % F.col("n_min"), "rank": (h60("j", F.lit(seed), F.lit("nb"), *by) % F.least(F.lit(k), F.col("n_min") - 1) + 1).cast("int"),
                           "lam": u01("j", F.lit(seed), F.lit("lam"), *by)})
    base = s.join(vecs.select(*by, "idx", unit, F.col(vec).alias("_a")), [*by, "idx"])
    t = base.join(nn.select(*by, unit, "rank", "nb"), [*by, unit, "rank"])
    t = t.join(vecs.select(*by, F.col(unit).alias("nb"), F.col(vec).alias("_b")), [*by, "nb"])
    mixed = F.zip_with("_a", "_b", lambda a, b: a + F.col("lam") * (b - a))
    return t.select(*by, "j", unit, "nb", "lam", mixed.alias(vec))


def calibration_view(splits: DataFrame, repeat: int, fold: int) -> DataFrame:
    """R19. Inner train / evaluation roles of one outer training part; the outer test never appears."""
    t = splits.filter((F.col("repeat") == repeat) & (F.col("outer_fold") == fold) & (F.col("role") == "train"))
    return t.withColumn("part", F.when(F.col("inner_fold") == 0, "evaluate").otherwise("train"))


def groups_disjoint(view: DataFrame, part: str, group: str) -> DataFrame:
    """Groups that appear in more than one part. Empty = disjoint."""
    return view.groupBy(group).agg(F.countDistinct(part).alias("k")).filter("k > 1").select(group)
