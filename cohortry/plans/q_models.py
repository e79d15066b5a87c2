"""Queries for models and inference (G rows), M8 and M16. Fits return small result tables; rows stay in Spark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import inference as I
from ..operators import metrics as M
from ..operators import models as G
from ..operators.clean import add_phase
from ..operators.resample import cluster_bootstrap
from ..operators.splits import grouped_folds, stratified_folds
from ..operators.profile import mean_vectors
from ..session import cut, shared
from . import views as V
from .q_joins import vectors
from .q_metrics import PAIRS, RATIO, fused, pooled, timebound
from .q_splits import CTX, NESTED, STRATA, nested, strata
from .registry import auc_sql, oracle, query

K = 5
DRAWS = 1000
GRID = (1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0)
FEATS = ["covariate", "n_lines", "n_digits", "uniq"]


def frame(spark, pdf: pd.DataFrame):
    """A small result table as a DataFrame, floats rounded for comparison across runs."""
    p = pdf.copy()
    for c in p.columns:
        if p[c].dtype.kind == "f":
            p[c] = p[c].round(6)
    return spark.createDataFrame(p)


def folds5(df, unit="unit", label="label"):
    return shared(stratified_folds(df.withColumn("_s", F.col(label).cast("string")), unit, "_s", K, 1, out="fold").select(unit, "fold"))


def context(spark, sf):
    """Cohort with an orthogonal spline context and three candidate scores (none of them the context itself)."""
    p = pooled(spark, sf).groupBy("unit").pivot("arm", list(V.ARMS)).agg(F.first("prob"))
    t, names = I.context_columns(V.cohort(spark, sf).join(p, "unit"), {"covariate": 4, "uniq": 4}, ["n_digits"])
    t, names = I.orthogonal_columns(cut(t), names)
    return cut(t), names  # a leaf for the many fits that follow


@query("m08_calibration")
def m08(spark, sf):
    return frame(spark, G.calibration(fused(spark, sf).withColumn("arm_repeat", F.concat_ws("|", "arm", F.col("repeat").cast("string"))), "label", "prob", "arm_repeat"))


@query("m16_compare_arms")
def m16(spark, sf):
    p = shared(fused(spark, sf))
    c = G.compare_arms(p, DRAWS, "boot", PAIRS, "label", "unit", RATIO)
    return c.select(*[F.round(n, 6).alias(n) if t == "double" else F.col(n) for n, t in c.dtypes])


@query("g01_fit_logit")
def g01(spark, sf):
    t = V.timebound(spark, sf)
    f = I.fit_many(I.design(t, ["priority"], ["start_hour", "age", "score"], "label"), [I.Spec("ml"), I.Spec("ridge", penalty=I.np.array([0, 1.0, 1.0, 1.0]))])
    d = I.fits_frame(spark, f)
    return d.select("key", "fit", F.posexplode("coef").alias("pos", "coef"), "converged").withColumn("coef", r6("coef"))


@query("g02_scale_in_fold", oracle(["timebound"], """select repeat, outer_fold, role, count(*) as n, cast(sum(unit) as bigint) as id_sum, round(sum((score-m)/case when s>0 then s else 1 end),4) as z_sum, round(sum(pow((score-m)/case when s>0 then s else 1 end,2)),4) as z_squares, round(sum((unit%97)*(score-m)/case when s>0 then s else 1 end),3) as z_by_id from nested join timebound using (unit)
 join (select repeat, outer_fold, avg(score) as m, stddev_pop(score) as s from nested join timebound using (unit) where role='train' group by 1,2) using (repeat, outer_fold) group by 1,2,3""", CTX + "," + STRATA + "," + NESTED))
def g02(spark, sf):
    t = shared(nested(spark, sf).select("unit", "repeat", "outer_fold", "role").join(V.timebound(spark, sf).select("unit", "score"), "unit"))
    z = G.scale_in_fold(t, ["score"], ["repeat", "outer_fold"])
    return z.groupBy("repeat", "outer_fold", "role").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.sum("unit").alias("id_sum"), F.round(F.sum("score_z"), 4).alias("z_sum"),
        F.round(F.sum(F.col("score_z") * F.col("score_z")), 4).alias("z_squares"), F.round(F.sum(F.col("unit") % 97 * F.col("score_z")), 3).alias("z_by_id"))


@query("g03_nested_cv")
def g03(spark, sf):
    from ..operators.splits import nested_splits

    c = V.cohort(spark, sf)
    s = nested_splits(c.withColumn("_s", F.col("label").cast("string")), "unit", "_s", K, 1).drop("_s")
    test, _ = G.nested_cv(c, s, {"text": FEATS, "length": ["covariate"]}, "label", "unit", K, grid=GRID)
    return test.select("arm", "unit", "repeat", "fold", r6("prob", "prob"), "C")


@query("g04_reference_arms")
def g04(spark, sf):
    """Out-of-fold context-only scores and their AUC under the six designs."""
    t = shared(timebound(spark, sf).withColumn("hour2", F.col("start_hour") * F.col("start_hour")))
    sets = {"age": ["age"], "hour_date": ["start_hour", "hour2", "days"], "all": ["age", "start_hour", "hour2", "days"]}
    o = G.reference_arms(t, sets, "label", "unit", folds5(t), K)
    w = shared(o.groupBy("unit").pivot("set", list(sets)).agg(F.first("prob")))
    j = t.select("unit", "label", "day", "start_hour", "overlap").join(w, "unit")
    return M.design_balance(j, "label", list(sets), "day", "start_hour", "overlap").withColumn("auc", r6("auc"))


@query("g05_onehot_logit")
def g05(spark, sf):
    t = V.timebound(spark, sf)
    o = G.onehot_logit(t, ["segment", "priority", "start_hour"], ["days"], "label", "unit", folds5(t), K)
    return M.auc(o, "y", "prob", ["fold"]).withColumn("auc", r6("auc"))


@query("g06_model_zoo")
def g06(spark, sf):
    c = V.cohort(spark, sf)
    z = G.model_zoo(c, FEATS, "label", "unit", folds5(c), range(K))
    return M.auc(shared(z), "y", "prob", ["arm", "fold"]).withColumn("auc", r6("auc"))


@query("g07_soft_vote", oracle(["predictions"], auc_sql("(select repeat, fold, unit, any_value(label) as label, avg(prob) as prob from (select arm, repeat, fold, unit, any_value(label) as label, avg(prob) as prob from predictions group by 1,2,3,4) group by 1,2,3) q", "repeat, fold", s="prob")))
def g07(spark, sf):
    p = V.predictions(spark, sf).groupBy("arm", "repeat", "fold", "unit", "label").agg(F.avg("prob").alias("prob"))
    return M.auc(G.soft_vote(p, ["repeat", "fold", "unit", "label"]), "label", "prob", ["repeat", "fold"]).withColumn("auc", r6("auc"))


INNER = "ia AS (" + auc_sql("(select arm, repeat, fold, unit, any_value(label) as label, avg(prob) as prob from inner_preds group by 1,2,3,4) q", "arm, repeat, fold", s="prob", digits=None) + """),
pf as (select arm, repeat, fold, unit, any_value(label) as label, avg(prob) as prob from predictions group by 1,2,3,4)"""


def inner_auc(spark, sf):
    f = shared(V.inner_preds(spark, sf).groupBy("arm", "repeat", "fold", "unit", "label").agg(F.avg("prob").alias("prob")))  # a ranking reads its rows three times
    return M.auc(f, "label", "prob", ["arm", "repeat", "fold"])


@query("g07_weighted_vote", oracle(["predictions", "inner_preds"], auc_sql("(select repeat, fold, unit, label, sum(prob*auc)/sum(auc) as prob from pf join ia using (arm, repeat, fold) group by 1,2,3,4) q", "repeat, fold", s="prob"), INNER))
def g07w(spark, sf):
    w = inner_auc(spark, sf).select("arm", "repeat", "fold", F.col("auc").alias("weight"))
    p = V.predictions(spark, sf).groupBy("arm", "repeat", "fold", "unit", "label").agg(F.avg("prob").alias("prob"))
    return M.auc(G.soft_vote(p, ["repeat", "fold", "unit", "label"], weights=w), "label", "prob", ["repeat", "fold"]).withColumn("auc", r6("auc"))


@query("g07_best_arms", oracle(["predictions", "inner_preds"], "select repeat, fold, arm from (select *, row_number() over (partition by repeat, fold order by auc desc, arm) as rn from ia) where rn<=2", INNER))
def g07b(spark, sf):
    return G.best_arms(inner_auc(spark, sf), ["repeat", "fold"], 2)


@query("g07_stack")
def g07s(spark, sf):
    p = shared(pooled(spark, sf))
    o = G.stack(p, "unit", "label", list(V.ARMS), folds5(V.cohort(spark, sf)), K)
    return M.auc(o, "y", "prob", ["fold"]).withColumn("auc", r6("auc"))


@query("g08_variant_study")
def g08(spark, sf):
    c = V.cohort(spark, sf)
    o = shared(G.variant_study(c, FEATS, "label", "unit", ["stratum"], folds5(c), K))
    m = G.variant_metrics(o, ["stratum"])
    return m.select(*[F.round(n, 6).alias(n) if t == "double" else F.col(n) for n, t in m.dtypes])


@query("g09_nested_choice", oracle(["predictions", "inner_preds"], auc_sql("(select pf.* from pf join (select repeat, fold, arg_max(arm, auc) as arm from ia group by 1,2) using (repeat, fold, arm)) q", "repeat, fold, arm", s="prob"), INNER))
def g09(spark, sf):
    return G.nested_choice(V.inner_preds(spark, sf), V.predictions(spark, sf), "label", "unit").withColumn("auc", r6("auc"))


@query("g10_spline_basis")
def g10(spark, sf):
    t, names = context(spark, sf)
    return t.select("unit", *[r6(n, n) for n in names])


@query("g11_fit_firth")
def g11(spark, sf):
    t, names = context(spark, sf)
    f = I.fit_many(I.design(t, [], [*names, "noise"], "label"), [I.Spec("full")], firth=True)
    d = I.fits_frame(spark, f)
    return d.select(F.posexplode("coef").alias("pos", "coef"), "converged", r6("ll", "ll")).withColumn("coef", r6("coef"))


@query("g12_score_increment_test")
def g12(spark, sf):
    t, names = context(spark, sf)
    return frame(spark, I.score_increment_test(t, names, list(V.ARMS), "label"))


@query("g13_cluster_cr1")
def g13(spark, sf):
    t, names = context(spark, sf)
    return frame(spark, I.score_increment_test(t, names, list(V.ARMS), "label", "cluster"))


@query("g14_cluster_cv3")
def g14(spark, sf):
    t, names = context(spark, sf)
    return frame(spark, I.score_increment_test(t, names, list(V.ARMS), "label", "cluster", jackknife=True))


@query("g15_bootstrap_or")
def g15(spark, sf):
    t, names = context(spark, sf)
    o = I.bootstrap_or(t, names, list(V.ARMS), "label", "unit", DRAWS, "or")
    return o.select("score", "draws", "usable", r6("low", "low"), r6("high", "high"))


@query("g16_lr_difference")
def g16(spark, sf):
    t, names = context(spark, sf)
    return frame(spark, I.lr_difference(t, names, "context", "noise", "label", "unit", DRAWS, "lr"))


@query("g17_fit_clogit")
def g17(spark, sf):
    t = timebound(spark, sf).filter("overlap")
    return frame(spark, I.conditional_test(t, "score", ["age", "days"], "label", "start_hour"))


@query("g18_cv_delta_auc")
def g18(spark, sf):
    t, names = context(spark, sf)
    d = I.cv_delta_auc(t, names, "signal", "label", "unit", K, 20)
    return d.select("n", r6("mean", "mean"), r6("sd", "sd"))


@query("g19_propensity")
def g19(spark, sf):
    t, names = context(spark, sf)
    return I.propensity(t, names, "label", "unit", K).select("unit", "fold", r6("c", "c"))


@query("g20_partial_permutation_test")
def g20(spark, sf):
    t, names = context(spark, sf)
    return frame(spark, I.partial_permutation_test(t, names, "context", "label", "unit", DRAWS, "pp"))


@query("g21_confound_test")
def g21(spark, sf):
    t, names = context(spark, sf)
    parts = [I.confound_test(t, names[0], "signal", "label", "unit", DRAWS, "cf", k) for k in ("partial", "full")]
    return frame(spark, pd.concat(parts, ignore_index=True))


@query("g22_ols_hc3")
def g22(spark, sf):
    t, names = context(spark, sf)
    return frame(spark, I.ols_hc3(t, [*names, "label"], "signal", names[:4]).fillna(0.0))


def vector_units(spark, sf):
    """Embeddings as units: case = label >= 5, context flag and group from the id, all dimensions as columns d0..d63 of the layer-free pooled vector."""
    v = vectors(spark, sf)
    cols = [F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(64)]
    return v.select(F.col("vec_id").alias("unit"), (F.col("label") >= 5).cast("long").alias("label"), (F.col("vec_id") % 2).cast("double").alias("pm"), (F.col("vec_id") % 30).cast("string").alias("grp"), "entity", *cols)


DIMS = [f"d{i}" for i in range(64)]


@query("g23_context_probe")
def g23(spark, sf):
    v = cut(vector_units(spark, sf))
    p = shared(G.context_probe(v, DIMS, "label", "pm", "unit", folds5(v, label="label"), K))
    return M.auc(p, "flag", "proxy", ["case"]).withColumn("auc", r6("auc"))


@query("g24_probe_arm")
def g24(spark, sf):
    v = cut(vector_units(spark, sf))
    o = G.probe_arm(G.probe_target(v, "label", "label"), DIMS, "grp", "unit", K)
    return M.auc(o, "y", "prob", ["fold"]).withColumn("auc", r6("auc"))


@query("g25_score_external")
def g25(spark, sf):
    from ..operators.joins import exclusion_closure

    v = cut(vector_units(spark, sf))
    ex = exclusion_closure(v, v.filter("d0 > 0.3"), "unit", "grp")
    ext = v.select("unit", *[(F.col(c) * 0.9).alias(c) for c in DIMS])
    return G.score_external(v, ext, ex, DIMS, "label", "unit", "grp", K, grid=GRID).select("unit", r6("prob", "prob"), "C")
