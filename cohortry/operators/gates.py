"""Decision and governance operators (D rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import n_if
from .clean import GuardError
from .ordered import attach_one

ALPHA = 0.05


def _true(c: Column) -> Column:
    """A comparison with NULL (a failed fit) does not hold."""
    return F.coalesce(c, F.lit(False))


def decision_table(t: DataFrame, alpha: float = ALPHA, veto: bool = True, status: tuple[str, str, str] = ("stage2_pending", "not_established", "not_met")) -> DataFrame:
    """D1. Conditions per arm with NULL = not applicable, the validity fail-safe and the status.

    Needs columns p_holm, or_sd, boot_lo, p_cv3, k2_valid, e2h_or, or_df6, g1_positive, n5_p.
    """
    up = F.col("or_sd") > 1
    c = t.withColumns({
        "c1_holm": _true((F.col("p_holm") < alpha) & up),
        "c2_boot": _true(F.col("boot_lo") > 1),
        "c3_cluster": F.when(F.col("k2_valid"), _true((F.col("p_cv3") < alpha) & up)),
        "c4_e2h": _true(F.col("e2h_or") > 1),
        "c5_direction": _true(up & (F.col("or_df6") > 1)),
        "c7_n5": F.when(F.col("g1_positive") & F.col("n5_p").isNotNull(), F.col("n5_p") >= alpha),
    })
    others = F.col("c1_holm") & F.col("c2_boot") & F.col("c4_e2h") & F.col("c5_direction")
    if veto:
        others = others & F.coalesce(F.col("c7_n5"), F.lit(True))
    met = others & F.col("k2_valid") & F.coalesce(F.col("c3_cluster"), F.lit(False))
    st = F.when(met, status[0]).when(others & ~F.col("k2_valid"), status[1]).otherwise(status[2])
    return c.withColumns({"stage1_all_met": met, "status": st, "stage2_triggered": F.col("c1_holm")})


def leakage_gate(aucs: DataFrame, feature_set: str, auc: str, reference: DataFrame, fixed: float, margin: float) -> DataFrame:
    """D2. Every feature set must stay at or below max(fixed, reference + margin); a missing AUC fails."""
    t = attach_one(aucs, reference.agg(F.max(auc).alias("reference")))
    t = t.withColumn("limit", F.greatest(F.lit(fixed), F.col("reference") + margin)).withColumn("passed", _true(F.col(auc) <= F.col("limit")))
    return t.select(feature_set, auc, "limit", "passed")


def gate_passed(gate: DataFrame) -> DataFrame:
    return gate.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"), F.count(F.lit(1)).cast("long").alias("n"))


def settings_gate(current: DataFrame, frozen: DataFrame) -> DataFrame:
    """D3. Settings (name, value) that differ from the frozen ones or exist on one side only. Empty = run allowed."""
    j = current.withColumnRenamed("value", "current").join(frozen.withColumnRenamed("value", "frozen"), "name", "full")
    return j.filter(~F.col("current").eqNullSafe(F.col("frozen")))


ID_PATTERN = r"(?<![\d.])(\d{6})(?![\d.])"


def scan_id_leaks(text: DataFrame, ids: DataFrame, c: str, key: str, id_col: str, pattern: str = ID_PATTERN) -> DataFrame:
    """D4. Standalone six-digit numbers in published text that are cohort ids; a number inside a decimal does not count."""
    found = text.select(key, F.explode(F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(1))).alias("_n")).select(key, F.col("_n").cast("long").alias(id_col))
    return found.join(ids.select(F.col(id_col).cast("long").alias(id_col)).distinct(), id_col, "left_semi").groupBy(key, id_col).agg(F.count(F.lit(1)).cast("long").alias("n"))


def check_predictions(preds: DataFrame, roles: DataFrame, unit: str, keys: Sequence[str], fold: str, prob: str, repeat: str = "repeat") -> DataFrame:
    """D5. Violation counts: repeated (keys, unit), units in several folds, units missing or foreign, rows outside the test role,
    probabilities outside [0, 1]. `keys` identify one prediction table (arm, task, repeat)."""
    dup = preds.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("c"), F.countDistinct(fold).alias("f"))
    a = dup.agg(n_if(F.col("c") > 1).alias("repeated"), n_if(F.col("f") > 1).alias("several_folds"))
    test = roles.filter("role = 'test'").select(unit, repeat, fold)
    out = preds.select(unit, repeat, fold).distinct().join(test, [unit, repeat, fold], "left_anti").agg(F.count(F.lit(1)).cast("long").alias("not_test_role"))
    gap = test.select(unit).distinct().join(preds.select(unit), unit, "left_anti").agg(F.count(F.lit(1)).cast("long").alias("unit_without_prediction"))
    rng = preds.agg(n_if(~_true(F.col(prob).between(0.0, 1.0))).alias("prob_outside_0_1"))
    one = attach_one(attach_one(attach_one(a, out), gap), rng)
    return one.unpivot([], one.columns, "check", "n")


def regression_check(new: DataFrame, ref: DataFrame, keys: Sequence[str], value: str, tol: float) -> DataFrame:
    """D6. Recomputed against stored values: difference, within-tolerance flag; a value missing on either side fails."""
    j = new.select(*keys, F.col(value).alias("new")).join(ref.select(*keys, F.col(value).alias("stored")), list(keys), "full")
    return j.withColumn("diff", F.abs(F.col("new") - F.col("stored"))).withColumn("ok", _true(F.col("diff") <= tol))


def sensitivity_flags(t: DataFrame, arm: str, variant: str, passed: str, main) -> DataFrame:
    """D7. Arms that pass the main analysis but fail under some alternative adjustment."""
    g = t.groupBy(arm).agg(F.bool_or((F.col(variant) == main) & F.col(passed)).alias("main_passed"),
                           F.bool_or((F.col(variant) != main) & ~F.col(passed)).alias("some_variant_fails"))
    return g.withColumn("flag", F.col("main_passed") & F.col("some_variant_fails"))


def publish(aggregate: DataFrame, units: DataFrame, ids: DataFrame, id_col: str, private_path: str, public_path: str, counts: Sequence[str] = ()) -> DataFrame:
    """D8. Unit rows go to the private sink; the aggregate goes to the public one only if the id scan is clean.

    `counts` names columns that hold numbers of rows: a count of six digits is some unit's id by chance and no leak. All other columns are scanned.
    Returns the leak rows (empty on success); raises if there are any.
    """
    units.write.mode("overwrite").parquet(private_path)
    text = aggregate.select(F.to_json(F.struct(*[c for c in aggregate.columns if c not in counts])).alias("text")).withColumn("key", F.md5("text"))
    leaks = scan_id_leaks(text, ids, "text", "key", id_col)
    if not leaks.isEmpty():
        raise GuardError("cohort ids in the public output; nothing was published")
    aggregate.write.mode("overwrite").json(public_path)
    return leaks
