"""Queries for the evaluation metrics (M rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import h60, h60_sql
from ..functions.numeric import r6
from ..operators import metrics as M
from ..operators.replicates import poisson_sql
from ..session import shared
from . import views as V
from .registry import auc_sql, oracle, query

B = 50
#: Replicates of the intervals.
DRAWS_N, MEAN_DRAWS = 2000, 1000
PAIRS = [("signal", "noise"), ("signal", "context"), ("context", "noise")]
COST = {"signal": 3.0, "context": 2.0, "noise": 1.0}
RATIO = 0.25  # n_test / n_train of five folds


def fused(spark, sf):
    return V.predictions(spark, sf).groupBy("arm", "repeat", "fold", "unit", "label", "stratum", "cluster").agg(F.round(F.avg("prob"), 6).alias("prob"))


def pooled(spark, sf):
    per = V.predictions(spark, sf).groupBy("arm", "repeat", "unit", "label", "stratum", "cluster").agg(F.avg("prob").alias("prob"))
    return per.groupBy("arm", "unit", "label", "stratum", "cluster").agg(F.round(F.avg("prob"), 6).alias("prob"))


def timebound(spark, sf):
    """Cohort with the common-support flag (date between first and last control date)."""
    t = V.timebound(spark, sf)
    from ..operators.clean import add_overlap_flag

    return add_overlap_flag(t, "day", "label", "overlap")


def fold_auc(spark, sf, groups: str = "true"):
    """groups: condition on the keys; only these groups are ranked (a filter after the AUC does not pass the ranking's joins and edges)."""
    p = V.predictions(spark, sf).filter(groups)
    return M.auc(p, "label", "prob", ["arm", "slot", "repeat", "fold"])


FOLD_AUC = "fold_auc AS (" + auc_sql("predictions", "arm, slot, repeat, fold", s="prob", digits=None) + ")"
FUSED_AUC = "fused_auc AS (" + auc_sql("fused", "arm, repeat, fold", s="prob", digits=None) + ")"
CODES = f"codes as (select distinct unit, {h60_sql('unit', "'boot'")} as code from pooled), cb as (select unit, code, unnest(range(0,{DRAWS_N})) as b from codes)"
DRAWS = CODES + ", w as (" + poisson_sql("code", "b", "cb", "unit, b") + """),
expanded as (select p.arm, w.b, p.label, p.prob from w join pooled p on p.unit=w.unit, unnest(range(0, w.w)) as k(i)),
boot as (""" + auc_sql("expanded", "arm, b", s="prob", digits=None) + ")"


@query("m01_auc", oracle(["predictions"], auc_sql("predictions", "arm, slot, repeat, fold", s="prob")))
def m01(spark, sf):
    return fold_auc(spark, sf).withColumn("auc", r6("auc"))


@query("m02_fold_summary", oracle(["predictions"], """
select arm, slot, count(auc) as n_folds, round(avg(auc),6) as mean, round(stddev_samp(auc),6) as sd, round(quantile_cont(auc,0.025),6) as p2_5,
 round(quantile_cont(auc,0.975),6) as p97_5, round(min(auc),6) as min, round(max(auc),6) as max from fold_auc group by 1,2""", FOLD_AUC))
def m02(spark, sf):
    s = M.fold_summary(fold_auc(spark, sf), ["arm", "slot"])
    return s.select("arm", "slot", "n_folds", *[r6(c, c) for c in ("mean", "sd", "p2_5", "p97_5", "min", "max")])


STRAT = """
select cast(sum(n1) as bigint) as n1, cast(sum(n0) as bigint) as n0, sum(n1::double*n0::double) as pairs,
 round(sum(wins)/sum(n1*n0)::double,6) as auc from
 (select stratum, cluster, sum(label) as n1, sum(1-label) as n0, sum(case when label=1 then rk else 0.0::double end) - sum(label)*(sum(label)+1)/2.0::double as wins
  from (select *, rank() over (partition by stratum, cluster order by score)::double + (count(*) over (partition by stratum, cluster, score)-1)/2.0::double as rk from cohort)
  group by 1,2)"""


@query("m03_stratified_auc", oracle(["cohort"], STRAT))
def m03(spark, sf):
    return M.stratified_auc(V.cohort(spark, sf), "label", "score", ["stratum", "cluster"]).withColumn("auc", r6("auc"))


TB_OVERLAP = """tb AS (select *, coalesce(day between (select min(day) from timebound where label=0) and (select max(day) from timebound where label=0), false) as overlap from timebound)"""
DESIGN_SQL = """
keyed as (
 select 'E1' as design, 'all' as k, t.* from tb t union all
 select 'E1h', cast(cast(floor(start_hour) as bigint) as varchar), t.* from tb t union all
 select 'E2', 'all', t.* from tb t where overlap union all
 select 'E2h', cast(cast(floor(start_hour) as bigint) as varchar), t.* from tb t where overlap union all
 select 'E3', cast(day as varchar), t.* from tb t union all
 select 'E3h', cast(day as varchar)||'|'||cast(cast(floor(start_hour) as bigint) as varchar), t.* from tb t),
long as (select design, k, label, m.measure, m.value from keyed, lateral (values ('start_hour',start_hour),('days',days),('age',age),('score',score)) m(measure,value)
  where k is not null and m.value is not null),
ranked as (select *, rank() over (partition by design,k,measure order by value)::double + (count(*) over (partition by design,k,measure,value)-1)/2.0::double as rk from long),
per as (select design,k,measure,sum(label) as n1, sum(1-label) as n0, sum(case when label=1 then rk else 0.0::double end)-sum(label)*(sum(label)+1)/2.0::double as wins from ranked group by 1,2,3)
"""


@query("m04_design_balance", oracle(["timebound"], """
select measure, design, cast(sum(n1) as bigint) as n1, cast(sum(n0) as bigint) as n0, sum(n1::double*n0::double) as pairs,
 case when sum(n1*n0)>0 then round(sum(wins)/sum(n1*n0)::double,6) end as auc from per group by 1,2""", TB_OVERLAP + "," + DESIGN_SQL))
def m04(spark, sf):
    d = M.design_balance(timebound(spark, sf), "label", ["start_hour", "days", "age", "score"], "day", "start_hour", "overlap")
    return d.withColumn("auc", r6("auc"))


@query("m05_confusion_metrics", oracle(["fused"], """
select arm, repeat, fold, tp, fp, tn, fn, round((tp+tn)/(tp+fp+tn+fn)::double,6) as accuracy, round(sens,6) as sens, round(spec,6) as spec,
 round((sens+spec)/2,6) as balacc, round(2*tp/greatest(1,2*tp+fp+fn)::double,6) as f1,
 round(coalesce((tp::double*tn-fp::double*fn)/nullif(sqrt((tp+fp)::double*(tp+fn)::double*(tn+fp)::double*(tn+fn)::double),0),0),6) as mcc
from (select *, tp/greatest(1,tp+fn)::double as sens, tn/greatest(1,tn+fp)::double as spec from
 (select arm, repeat, fold, count(*) filter (prob>=0.5 and label=1) as tp, count(*) filter (prob>=0.5 and label=0) as fp,
  count(*) filter (prob<0.5 and label=0) as tn, count(*) filter (prob<0.5 and label=1) as fn from fused group by 1,2,3))"""))
def m05(spark, sf):
    g = M.confusion_metrics(fused(spark, sf), "label", "prob", 0.5, ["arm", "repeat", "fold"])
    return g.select("arm", "repeat", "fold", "tp", "fp", "tn", "fn", *[r6(c, c) for c in ("accuracy", "sens", "spec", "balacc", "f1", "mcc")])


@query("m06_best_threshold", oracle(["inner_preds"], """
select arm, repeat, fold, round(median(t),6) as threshold, round(max(ba),6) as balacc from
 (select *, max(ba) over (partition by arm, repeat, fold) as best from
  (select arm, repeat, fold, t, round((tp/greatest(1,p)::double + tn/greatest(1,n)::double)/2,12) as ba from
   (select c.arm, c.repeat, c.fold, c.prob as t, count(*) filter (f.label=1 and f.prob>=c.prob) as tp, count(*) filter (f.label=0 and f.prob<c.prob) as tn,
     count(*) filter (f.label=1) as p, count(*) filter (f.label=0) as n
    from (select distinct arm, repeat, fold, prob from f0) c join f0 f on c.arm=f.arm and c.repeat=f.repeat and c.fold=f.fold group by 1,2,3,4)))
 where ba=best group by 1,2,3""",
 "f0 as (select arm, repeat, fold, unit, any_value(label) as label, round(avg(prob),6) as prob from inner_preds group by 1,2,3,4)"))
def m06(spark, sf):
    f = V.inner_preds(spark, sf).groupBy("arm", "repeat", "fold", "unit", "label").agg(F.round(F.avg("prob"), 6).alias("prob"))
    t = M.best_threshold(f, "label", "prob", ["arm", "repeat", "fold"])
    return t.select("arm", "repeat", "fold", r6("threshold", "threshold"), r6("balacc", "balacc"))


@query("m07_average_precision", oracle(["fused"], """
select arm, repeat, round(max(case when cls=1 then ap end),6) as ap_1, round(max(case when cls=0 then ap end),6) as ap_0 from
 (select arm, repeat, cls, sum(hit*prec)/sum(hit)::double as ap from
  (select *, sum(hit) over (partition by arm,repeat,cls order by k desc range unbounded preceding)/count(*) over (partition by arm,repeat,cls order by k desc range unbounded preceding)::double as prec
   from (select arm, repeat, 1 as cls, label as hit, prob as k from fused union all select arm, repeat, 0, 1-label, -prob from fused)) group by 1,2,3) group by 1,2"""))
def m07(spark, sf):
    g = M.average_precision(fused(spark, sf), "label", "prob", ["arm", "repeat"])
    return g.select("arm", "repeat", r6("ap_1", "ap_1"), r6("ap_0", "ap_0"))


@query("m09_auc_ci", oracle(["pooled"], """
select arm, count(auc) as n_ok, round(quantile_cont(auc,0.025),6) as ci_low, round(quantile_cont(auc,0.975),6) as ci_high from boot group by 1""", DRAWS))
def m09(spark, sf):
    g = M.auc_interval(pooled(spark, sf), "label", "prob", "unit", DRAWS_N, "boot", ["arm"])
    return g.select("arm", "n_ok", r6("ci_low", "ci_low"), r6("ci_high", "ci_high"))


@query("m10_auc_delta_ci", oracle(["pooled"], """
select arm_a, arm_b, max(pd) as delta, count(d) as n_ok, round(quantile_cont(d,0.025),6) as ci_low, round(quantile_cont(d,0.975),6) as ci_high from
 (select p.a as arm_a, p.b as arm_b, x.auc-y.auc as d, (select round(u.auc-v.auc,6) from point u, point v where u.arm=p.a and v.arm=p.b) as pd
  from (values ('signal','noise'),('signal','context'),('context','noise')) p(a,b) join boot x on x.arm=p.a join boot y on y.arm=p.b and x.b=y.b
  where x.auc is not null and y.auc is not null) group by 1,2""", DRAWS + ", point as (" + auc_sql("pooled", "arm", s="prob", digits=None) + ")"))
def m10(spark, sf):
    g = M.auc_delta_interval(shared(pooled(spark, sf)), "label", "prob", "arm", PAIRS, "unit", DRAWS_N, "boot")
    return g.select("arm_a", "arm_b", r6("delta", "delta"), "n_ok", r6("ci_low", "ci_low"), r6("ci_high", "ci_high"))


@query("m11_delong", oracle(["pooled"], """
select arm_a, arm_b, n1, n0, round(d,6) as delta, round(case when v>0 then d/sqrt(v) else 0 end,6) as z from
 (select p.a as arm_a, p.b as arm_b, count(*) filter (x.label=1) as n1, count(*) filter (x.label=0) as n0,
   avg(case when x.label=1 then x.v-y.v end) as d,
   var_samp(case when x.label=1 then x.v-y.v end)/count(*) filter (x.label=1) + var_samp(case when x.label=0 then x.v-y.v end)/count(*) filter (x.label=0) as v
  from (values ('signal','noise'),('signal','context'),('context','noise')) p(a,b) join pl x on x.arm=p.a join pl y on y.arm=p.b and x.unit=y.unit group by 1,2)""",
 """pl as (select a.arm, a.unit, a.label, avg(case when a.label=1 then (case when a.prob>b.prob then 1.0::double when a.prob=b.prob then 0.5::double else 0 end)
   else (case when b.prob>a.prob then 1.0::double when a.prob=b.prob then 0.5::double else 0 end) end) as v from pooled a join pooled b on a.arm=b.arm and a.label<>b.label group by 1,2,3)"""))
def m11(spark, sf):
    d = M.delong(shared(pooled(spark, sf)), "label", "prob", "arm", PAIRS)
    return d.select("arm_a", "arm_b", "n1", "n0", r6("delta", "delta"), r6("z", "z"))


@query("m12_hanley_mcneil", oracle(["predictions"], """
select arm, slot, repeat, fold, round(sqrt((a*(1-a)+(n1-1)*(a/(2-a)-a*a)+(n0-1)*(2*a*a/(1+a)-a*a))/(n1::double*n0)),6) as se,
 round(1.96::double*sqrt((a*(1-a)+(n1-1)*(a/(2-a)-a*a)+(n0-1)*(2*a*a/(1+a)-a*a))/(n1::double*n0)),6) as half_width
from (select *, auc as a from fold_auc)""", FOLD_AUC))
def m12(spark, sf):
    f = fold_auc(spark, sf)
    se = M.hanley_mcneil("auc", "n1", "n0")
    return f.select("arm", "slot", "repeat", "fold", r6(se, "se"), r6(1.96 * se, "half_width"))


NB = """
select arm_a, arm_b, count(*) as n, round(avg(d),6) as mean, round(case when var_samp(d)>0 then avg(d)/sqrt((1.0::double/count(*)+0.25::double)*var_samp(d))
  else case when avg(d)=0 then 0 else sign(avg(d))*'inf'::double end end,6) as t from
 (select p.a as arm_a, p.b as arm_b, x.auc-y.auc as d from (values ('signal','noise'),('signal','context'),('context','noise')) p(a,b)
  join fused_auc x on x.arm=p.a join fused_auc y on y.arm=p.b and x.repeat=y.repeat and x.fold=y.fold) group by 1,2"""


def fold_deltas(spark, sf):
    f = M.auc(fused(spark, sf), "label", "prob", ["arm", "repeat", "fold"])
    return M.pair_difference(f, ["repeat", "fold"], "arm", "auc", PAIRS)


@query("m13_nadeau_bengio", oracle(["fused"], NB, FUSED_AUC))
def m13(spark, sf):
    g = M.nadeau_bengio(fold_deltas(spark, sf), "delta", RATIO, ["arm_a", "arm_b"])
    return g.select("arm_a", "arm_b", "n", r6("mean", "mean"), r6("t", "t"))


@query("m14_holm", oracle(["predictions"], """
select arm, slot, p, round(max(least(1.0::double, (m-i+1)*p)) over (partition by arm order by i),6) as p_holm from
 (select arm, slot, p, row_number() over (partition by arm order by p, slot) as i, count(*) over (partition by arm) as m from
  (select arm, slot, round(count(*) filter (auc<=0.5)/count(*)::double,6) as p from fold_auc group by 1,2))""", FOLD_AUC))
def m14(spark, sf):
    """Sign-test style p per (arm, slot) from the fold table, adjusted inside each arm."""
    f = fold_auc(spark, sf)
    p = f.groupBy("arm", "slot").agg(F.round(F.count_if(F.col("auc") <= 0.5) / F.count(F.lit(1)), 6).alias("p"))
    return M.holm(p, "p", ["arm"], tie=["slot"]).select("arm", "slot", "p", r6("p_holm", "p_holm"))


@query("m14_intersection_union", oracle(["predictions"], """
select arm, round(max(p),6) as p_max from (select arm, slot, round(count(*) filter (auc<=0.5)/count(*)::double,6) as p from fold_auc group by 1,2) group by 1""", FOLD_AUC))
def m14b(spark, sf):
    f = fold_auc(spark, sf)
    p = f.groupBy("arm", "slot").agg(F.round(F.count_if(F.col("auc") <= 0.5) / F.count(F.lit(1)), 6).alias("p"))
    return M.intersection_union(p, "p", ["arm"])


@query("m15_wilson", oracle(["cohort"], """
select cluster, k, n, round((p+z*z/(2*n))/(1+z*z/n) - z*sqrt(p*(1-p)/n+z*z/(4.0::double*n*n))/(1+z*z/n),6) as lo,
 round((p+z*z/(2*n))/(1+z*z/n) + z*sqrt(p*(1-p)/n+z*z/(4.0::double*n*n))/(1+z*z/n),6) as hi
from (select cluster, cast(sum(label) as bigint) as k, count(*) as n, avg(label) as p, 1.96::double as z from cohort group by 1)"""))
def m15(spark, sf):
    g = V.cohort(spark, sf).groupBy("cluster").agg(F.sum("label").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = M.wilson("k", "n")
    return g.select("cluster", "k", "n", r6(lo, "lo"), r6(hi, "hi"))


@query("m17_context_monitors", oracle(["timebound"], auc_sql(
    """(select 'late' as monitor, label as fixed, case when day is null then null when day <= (select max(day) from timebound where label=0) then 0 else 1 end as flag, score from timebound
        union all select 'pm', label, case when start_hour is null then null when start_hour<12 then 0 else 1 end, score from timebound) m""",
    "monitor, fixed", y="flag").replace("where score is not null", "where flag is not null")))
def m17(spark, sf):
    from ..operators.clean import add_phase

    t = add_phase(V.timebound(spark, sf), "day", "label", "phase")
    t = t.select(
        F.col("label").alias("fixed"), "score", F.when(F.col("phase") != "unknown", (F.col("phase") == "late").cast("int")).alias("late"),
        F.when(F.col("start_hour").isNotNull(), (F.col("start_hour") >= 12).cast("int")).alias("pm"),
    )
    return M.context_monitors(t, "fixed", "score", ["late", "pm"]).withColumn("auc", r6("auc"))


@query("m18_exclusion_sensitivity", oracle(["fused"], auc_sql(
    "(select 'all' as subset, * from fused union all select 'excluded', * from fused where unit not in (select doc_id from labels where toxic=1)) q",
    "subset, arm, repeat, fold", s="prob")))
def m18(spark, sf):
    flagged = V.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("unit"))
    return M.exclusion_sensitivity(fused(spark, sf), flagged, "label", "prob", ["arm", "repeat", "fold"]).withColumn("auc", r6("auc"))


@query("m19_score_shift", oracle(["predictions"], """
select a.arm, a.affected, count(*) as n, round(avg(abs(a.p-b.p)),6) as mean_abs, round(max(abs(a.p-b.p)),6) as max_abs from
 (select arm, unit, stratum='en' as affected, round(avg(prob),6) as p from predictions where repeat=0 group by 1,2,3) a join
 (select arm, unit, round(avg(prob),6) as p from predictions where repeat=1 group by 1,2) b on a.arm=b.arm and a.unit=b.unit group by 1,2"""))
def m19(spark, sf):
    p = V.predictions(spark, sf)
    f = p.groupBy("arm", "unit", "repeat", (F.col("stratum") == "en").alias("affected")).agg(F.round(F.avg("prob"), 6).alias("p"))
    g = M.score_shift(f.filter("repeat = 0"), f.filter("repeat = 1"), "affected", "p", ["arm", "unit"], ["arm"])
    return g.select("arm", "affected", "n", r6("mean_abs", "mean_abs"), r6("max_abs", "max_abs"))


SELECT_SQL = """
inner_auc as (""" + auc_sql("(select arm, repeat, fold, unit, any_value(label) as label, round(avg(prob),9) as prob from inner_preds group by 1,2,3,4) q", "arm, repeat, fold", s="prob", digits=None) + """),
picked as (select repeat, fold, arm as selected, auc as inner_auc, n_tied from
 (select *, count(*) over (partition by repeat, fold) as n_tied,
   row_number() over (partition by repeat, fold order by case arm when 'signal' then 3 when 'context' then 2 else 1 end, arm) as rn
  from (select *, max(auc) over (partition by repeat, fold) as top from inner_auc) where top-auc < 0.01) where rn=1)"""


@query("m20_select_per_fold", oracle(["inner_preds"], "select repeat, fold, selected, round(inner_auc,6) as inner_auc, n_tied from picked", SELECT_SQL))
def m20(spark, sf):
    return M.select_per_fold(V.inner_preds(spark, sf), "label", "prob", "arm", COST).withColumn("inner_auc", r6("inner_auc"))


@query("m20_selection_guard", oracle(["inner_preds"], "select 'rows' as check_name, 0 as n_violations union all select 'checked', count(*) from (select distinct repeat, fold, unit from inner_preds)"))
def m20_guard(spark, sf):
    inner, roles = V.inner_preds(spark, sf), V.fold_roles(spark, sf)
    v = M.selection_guard(inner, roles).agg(F.lit("rows").alias("check_name"), F.count(F.lit(1)).cast("long").alias("n_violations"))
    n = inner.select("repeat", "fold", "unit").distinct().agg(F.lit("checked").alias("check_name"), F.count(F.lit(1)).cast("long").alias("n_violations"))
    return v.unionByName(n)


@query("m21_procedure_estimate", oracle(["inner_preds", "fused"], """
select round((select avg(auc) from got),6) as procedure_mean, round((select stddev_samp(auc) from got),6) as procedure_sd, (select count(*) from got) as n_folds,
 round(max(m),6) as best_fixed_mean, arg_max(arm, m) as best_fixed_arm, round((select avg(x) from (select max(auc) as x from fused_auc group by repeat, fold)),6) as oracle_mean,
 round(max(m)-(select avg(auc) from got),6) as winners_curse from (select arm, avg(auc) as m from fused_auc group by 1)""",
 SELECT_SQL + "," + FUSED_AUC + ", got as (select auc from picked p join fused_auc f on p.selected=f.arm and p.repeat=f.repeat and p.fold=f.fold)"))
def m21(spark, sf):
    sel = M.select_per_fold(V.inner_preds(spark, sf), "label", "prob", "arm", COST)
    folds = M.auc(fused(spark, sf), "label", "prob", ["arm", "repeat", "fold"])
    e = M.procedure_estimate(sel, folds)
    return e.select(*[r6(c, c) for c in ("procedure_mean", "procedure_sd")], "n_folds", r6("best_fixed_mean", "best_fixed_mean"), "best_fixed_arm",
                    r6("oracle_mean", "oracle_mean"), r6("winners_curse", "winners_curse"))


@query("m21_selection_counts", oracle(["inner_preds"], "select selected, count(*) as n_folds from picked group by 1", SELECT_SQL))
def m21b(spark, sf):
    return M.selection_counts(M.select_per_fold(V.inner_preds(spark, sf), "label", "prob", "arm", COST))


@query("m22_slot_contrast", oracle(["predictions"], """
select arm, count(*) as n, round(avg(d),6) as mean, round(avg(d)/sqrt((1.0::double/count(*)+0.25::double)*var_samp(d)),6) as t from
 (select arm, repeat, fold, avg(case when slot=1 then auc end)-avg(case when slot<>1 then auc end) as d from fold_auc group by 1,2,3) group by 1""", FOLD_AUC))
def m22(spark, sf):
    g = M.slot_contrast(fold_auc(spark, sf), "slot", "auc", 1, RATIO, ["arm"])
    return g.select("arm", "n", r6("mean", "mean"), r6("t", "t"))


@query("m23_cell_means", oracle(["cohort"], """
select p.label, p.stratum, n, round(mean,6) as mean, round(quantile_cont(m,0.025),6) as ci_low, round(quantile_cont(m,0.975),6) as ci_high, count(m) as n_ok
from (select label, stratum, count(*) as n, avg(score) as mean from cohort group by 1,2) p join dm on dm.label=p.label and dm.stratum=p.stratum group by 1,2,3,mean""",
 f"""cb as (select label, stratum, score, {h60_sql('unit', "'cell'")} as code, unnest(range(0,{MEAN_DRAWS})) as b from cohort),
 w as (""" + poisson_sql("code", "b", "cb", "label, stratum, score, b") + """),
 dm as (select label, stratum, b, sum(score*w)/nullif(sum(w),0) as m from w group by 1,2,3)"""))
def m23(spark, sf):
    g = M.cell_means(V.cohort(spark, sf), "score", ["label", "stratum"], "unit", MEAN_DRAWS, "cell")
    return g.select("label", "stratum", "n", r6("mean", "mean"), r6("ci_low", "ci_low"), r6("ci_high", "ci_high"), "n_ok")


@query("m23_cell_difference", oracle(["timebound"], """
select n_a, n_b, round(difference,6) as difference, n_ok, round(ci_low,6) as ci_low, round(ci_high,6) as ci_high from
 (select count(*) filter (half='AM') as n_a, count(*) filter (half='PM') as n_b, avg(case when half='AM' then score end)-avg(case when half='PM' then score end) as difference from ctl),
 (select count(d) as n_ok, quantile_cont(d,0.025) as ci_low, quantile_cont(d,0.975) as ci_high from (select b, max(case when half='AM' then m end)-max(case when half='PM' then m end) as d from dm group by 1))""",
 f"""ctl as (select unit, score, case when start_hour<12 then 'AM' else 'PM' end as half from timebound where label=0 and start_hour is not null),
 cb as (select half, score, {h60_sql('unit', "'half'")} as code, unnest(range(0,{MEAN_DRAWS})) as b from ctl),
 w as (""" + poisson_sql("code", "b", "cb", "half, score, b") + """),
 dm as (select half, b, sum(score*w)/nullif(sum(w),0) as m from w group by 1,2)"""))
def m23b(spark, sf):
    t = V.timebound(spark, sf).filter("label = 0 and start_hour is not null").withColumn("half", F.when(F.col("start_hour") < 12, "AM").otherwise("PM"))
    g = M.cell_difference(t, "score", "half", "AM", "PM", "unit", MEAN_DRAWS, "half")
    return g.select("n_a", "n_b", r6("difference", "difference"), "n_ok", r6("ci_low", "ci_low"), r6("ci_high", "ci_high"))


@query("m24_paired_chain_diff", oracle(["slot_rows"], """
select (select count(*) from u) as n_entities, (select round(avg(d),6) from u) as mean_diff, round(quantile_cont(m,0.025),6) as ci_low, round(quantile_cont(m,0.975),6) as ci_high from
 (select b, sum(d*w)/nullif(sum(w),0) as m from w group by 1)""",
 f"""u as (select entity, d from (select entity, avg(case when chain='x' then dur end)-avg(case when chain='y' then dur end) as d
  from slot_rows group by 1 having count(distinct chain)=2) where d is not null),
 cb as (select d, {h60_sql('entity', "'chain'")} as code, unnest(range(0,{MEAN_DRAWS})) as b from u),
 w as (""" + poisson_sql("code", "b", "cb", "d, b") + ")"))
def m24(spark, sf):
    d = shared(M.paired_chain_diff(V.slot_rows(spark, sf), "entity", "chain", "dur", "x", "y"))
    g = M.paired_mean_interval(d, "entity", MEAN_DRAWS, "chain")
    return g.select("n_entities", *[r6(c, c) for c in ("mean_diff", "ci_low", "ci_high")])


@query("m25_stratum_sizes", oracle(["timebound"], """
select count(*) as n_strata, cast(sum(n1) as bigint) as n1, cast(sum(n0) as bigint) as n0, sum(n1::double*n0::double) as pairs from
 (select day, sum(label) as n1, sum(1-label) as n0 from timebound where day is not null group by 1 having sum(label)>0 and sum(1-label)>0)"""))
def m25(spark, sf):
    s = M.stratum_sizes(V.timebound(spark, sf), "label", ["day"])
    return s.agg(F.count(F.lit(1)).cast("long").alias("n_strata"), *[F.sum(c).cast("long").alias(c) for c in ("n1", "n0")], F.sum("pairs").alias("pairs"))
