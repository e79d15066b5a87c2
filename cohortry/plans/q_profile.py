"""Queries for aggregations (A), sets (K) and association tests (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import h60, h60_sql, u01, u01_sql
from ..functions.numeric import chi2_sf, norm_sf, r6, t_sf
from ..operators import association as T
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import profile as A
from ..operators import sets as K
from ..operators.clean import add_phase
from ..operators.replicates import draws_sql
from . import views as V
from .q_joins import N, SLOTS, grid, vectors
from .q_metrics import FOLD_AUC, fold_auc, fused, timebound
from .registry import auc_sql, oracle, query


@query("a01_value_counts", oracle(["timebound"], "select coalesce(cast(cast(start_hour as bigint) as varchar),'<null>') as value, count(*) as n, round(count(*)/(select count(*) from timebound)::double,6) as share from timebound group by 1"))
def a01(spark, sf):
    t = V.timebound(spark, sf).withColumn("h", F.col("start_hour").cast("long"))
    return A.value_counts(t, "h").withColumn("share", r6("share"))


@query("a01_crosstab", oracle(["timebound"], "select segment, priority, count(*) as n, round(count(*)/sum(count(*)) over (partition by segment)::double,6) as row_share from timebound group by 1,2"))
def a01b(spark, sf):
    return A.crosstab(V.timebound(spark, sf), "segment", "priority").withColumn("row_share", r6("row_share"))


COHORTS_SQL = """mem as (select 'all' as cohort, * from timebound union all select 'afternoon', * from timebound where start_hour>=12 union all select 'late_hours', * from timebound where start_hour>=16)"""


@query("a02_describe_by", oracle(["timebound"], """select cohort, label, m.variable as variable, count(m.value) as n, round(quantile_cont(m.value,0.25),6) as q25, round(quantile_cont(m.value,0.5),6) as median, round(quantile_cont(m.value,0.75),6) as q75,
 round(avg(m.value),6) as mean, round(stddev_samp(m.value),6) as sd, round(min(m.value),6) as min, round(max(m.value),6) as max from mem, lateral (values ('age',age),('score',score)) m(variable,value) where m.value is not null group by 1,2,3""", COHORTS_SQL))
def a02(spark, sf):
    t = A.with_cohorts(V.timebound(spark, sf), {"all": F.lit(True), "afternoon": F.col("start_hour") >= 12, "late_hours": F.col("start_hour") >= 16})
    d = A.describe_by(t, ["age", "score"], ["cohort", "label"])
    return d.select("cohort", "label", "variable", "n", *[r6(c, c) for c in ("q25", "median", "q75", "mean", "sd", "min", "max")])


def _day_sql(p):
    return f"""select '{p}' as period, count(*) as periods, count(*) filter (n0=0) as case_only, count(*) filter (n1=0) as control_only, count(*) filter (n1>0 and n0>0) as both,
 cast(sum(case when n1>0 and n0>0 then 0 else n1+n0 end) as bigint) as units_one_sided, sum(n1::double*n0::double) as pairs from (select date_trunc('{p}', day) as p, sum(label) as n1, sum(1-label) as n0 from timebound group by 1)"""


@query("a03_day_structure", oracle(["timebound"], _day_sql("day") + " union all " + _day_sql("week")))
def a03(spark, sf):
    t = V.timebound(spark, sf)
    parts = [A.day_structure(t, F.date_trunc(p, "day"), "label").withColumn("period", F.lit(p)) for p in ("day", "week")]
    return parts[0].unionByName(parts[1])


@query("a04_session_summary", oracle(["slot_rows"], """select n, count(*) as n_entities, round(avg(share),6) as share, round(avg(start_hour),6) as start_hour, round(avg(minutes),6) as minutes from
 (select entity, count(ts) as n, avg(cast(chain='x' as int)) as share, hour(min(ts))+minute(min(ts))/60.0::double as start_hour, date_diff('second',min(ts),max(ts))/60.0::double as minutes from slot_rows group by 1) group by 1"""))
def a04(spark, sf):
    s = A.session_summary(V.slot_rows(spark, sf), "entity", "ts", F.col("chain") == "x")
    return s.groupBy("n").agg(F.count(F.lit(1)).cast("long").alias("n_entities"), *[r6(F.avg(c), c) for c in ("share", "start_hour", "minutes")])


@query("a05_mix_signature", oracle(["slot_rows"], "select signature, count(*) as n from (select entity, string_agg(distinct flag, '+' order by flag) as signature from slot_rows group by 1) group by 1"))
def a05(spark, sf):
    return A.mix_signature(V.slot_rows(spark, sf), "entity", "flag")


@query("a06_coverage", oracle(["grid"], """select n_ok, case when n_ok=7 then 'complete' when n_ok=0 then 'none' else 'partial' end as kind, count(*) as n_entities from (select entity, count(*) filter (status='OK') as n_ok from grid group by 1) group by 1,2"""))
def a06(spark, sf):
    return A.coverage(grid(spark, sf), "entity")


@query("a06_missing_by_slot", oracle(["grid"], """select slot, count(*) filter (status='OK') as "OK", count(*) filter (status='MISSING') as "MISSING", count(*) filter (status='MULTIPLE') as "MULTIPLE" from grid group by 1"""))
def a06b(spark, sf):
    return A.missing_by_slot(grid(spark, sf), "slot")


@query("a07_date_agreement", oracle([], """select chain, count(delta) as n, round(quantile_cont(delta,0.05),6) as q05, round(quantile_cont(delta,0.5),6) as median, round(quantile_cont(delta,0.95),6) as q95,
 round(avg(cast(delta=0 as int)),6) as same_day, round(avg(cast(abs(delta)<=1 as int)),6) as within_1, count(*) filter (b is null and a is not null) as filled from
 (select case when l_returnflag='A' then 'x' else 'y' end as chain, cast(l_shipdate as date) as a, case when o_orderstatus<>'P' then cast(o_orderdate as date) end as b,
   date_diff('day', case when o_orderstatus<>'P' then cast(o_orderdate as date) end, cast(l_shipdate as date)) as delta from lineitem join orders on l_orderkey=o_orderkey) group by 1"""))
def a07(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("declared"))
    t = V.slot_rows(spark, sf).select("entity", "chain", F.to_date("ts").alias("seen")).join(o, "entity")
    d = A.date_agreement(t, "seen", "declared", ["chain"])
    return d.select("chain", "n", *[r6(c, c) for c in ("q05", "median", "q95", "same_day", "within_1")], "filled")


CHI_SQL = """chi as (select variable, cast(max(n_all) as bigint) as n, max(dof) as dof, case when max(dof)=0 then 0 when max(dof)=1 then sum(pow(greatest(abs(o-e)-0.5,0),2)/e) else sum(pow(o-e,2)/e) end as chi2 from
 (select a.variable, coalesce(c.n,0) as o, a.n::double*b.n::double/t.n as e, t.n as n_all, (t.ra-1)*(t.rb-1) as dof from
   (select variable, value, sum(n) as n from cells group by 1,2) a join (select variable, label, sum(n) as n from cells group by 1,2) b using (variable)
   join (select variable, sum(n) as n, count(distinct value) as ra, count(distinct label) as rb from cells group by 1) t using (variable)
   left join cells c on c.variable=a.variable and c.value=a.value and c.label=b.label) group by 1)"""


@query("a08_metadata_screen", oracle(["timebound"], """select c.variable, n_values, round(top_share,6) as top_share, n_values=1 as uniform, c.n, c.dof, round(c.chi2,6) as chi2 from chi c join
 (select variable, count(*) as n_values, max(k)/sum(k)::double as top_share from (select variable, value, sum(n) as k from cells group by 1,2) group by 1) v using (variable)""",
 """cells as (select m.variable, coalesce(m.value,'<null>') as value, label, count(*) as n from timebound, lateral (values ('segment',segment),('priority',priority),('hour',cast(cast(start_hour as bigint) as varchar)),('const','c'),('half', case when start_hour<12 then 'AM' else 'PM' end)) m(variable,value) group by 1,2,3),""" + CHI_SQL))
def a08(spark, sf):
    t = V.timebound(spark, sf).withColumns({"hour": F.col("start_hour").cast("long"), "const": F.lit("c"), "half": F.when(F.col("start_hour") < 12, "AM").otherwise("PM")})
    s = A.metadata_screen(t, ["segment", "priority", "hour", "const", "half"], "label")
    return s.select("variable", "n_values", r6("top_share", "top_share"), "uniform", "n", "dof", r6("chi2", "chi2"))


@query("a09_nuisance_screen", oracle(["cohort"], "select stratum, feature, n1, n0, round(auc,6) as auc, round(abs(auc-0.5),6) as strength from au where n1+n0>=10 and auc is not null order by round(abs(auc-0.5),9) desc, stratum, feature limit 15",
 "lng as (select stratum, label, m.feature, m.score from cohort, lateral (values ('covariate',covariate),('n_lines',n_lines::double),('n_digits',n_digits::double),('uniq',uniq)) m(feature,score)), au as (" + auc_sql("lng", "stratum, feature", digits=None) + ")"))
def a09(spark, sf):
    s = A.nuisance_screen(V.cohort(spark, sf), ["covariate", "n_lines", "n_digits", "uniq"], "label", ["stratum"])
    return s.select("stratum", "feature", "n1", "n0", r6("auc", "auc"), r6("strength", "strength"))


@query("a10_fuse", oracle(["predictions"], """select unit, arm, repeat, fold, 'fusion' as task, round(avg(prob),6) as prob from predictions where arm<>'context' group by 1,2,3,4
 union all select unit, arm, repeat, fold, 'fusion', round(prob,6) from predictions where arm='context' and slot=1"""))
def a10(spark, sf):
    p = V.predictions(spark, sf).filter((F.col("arm") != "context") | (F.col("slot") == 1))
    return A.fuse(p, ["unit", "arm", "repeat", "fold"], F.col("arm") == "context").withColumn("prob", r6("prob"))


@query("a11_pool", oracle(["predictions"], """select unit, arm, round(avg(p),6) as on_prob, round(avg(ln(greatest(1e-6::double,least(1-1e-6::double,p))/(1-greatest(1e-6::double,least(1-1e-6::double,p))))),6) as on_logit from
 (select unit, arm, repeat, avg(prob) as p from predictions group by 1,2,3) group by 1,2"""))
def a11(spark, sf):
    p = V.predictions(spark, sf)
    a = A.pool(p, ["unit", "arm"]).select("unit", "arm", r6("score", "on_prob"))
    return a.join(A.pool(p, ["unit", "arm"], on="logit").select("unit", "arm", r6("score", "on_logit")), ["unit", "arm"])


@query("a12_mean_vectors", """select entity, cast(i-1 as bigint) as pos, round(avg(embedding[i]::double),6) as x from (select vec_id%100 as entity, embedding, unnest(range(1,len(embedding)+1)) as i from embeddings) group by 1,2""")
def a12(spark, sf):
    v = vectors(spark, sf)
    A_ok = v.join(A.non_finite(v, "embedding").select("vec_id"), "vec_id", "left_anti")
    m = A.mean_vectors(A_ok, ["entity"], "embedding")
    return m.select("entity", F.posexplode("vec").alias("pos", "x")).select("entity", F.col("pos").cast("long").alias("pos"), r6("x", "x"))


def layered(spark, sf):
    v = vectors(spark, sf).select("vec_id", (F.col("vec_id") % 5 != 0).alias("train"), F.posexplode("embedding").alias("p", "x"))
    return v.select("vec_id", "train", F.floor(F.col("p") / 8).cast("long").alias("layer"), (F.col("p") % 8).cast("long").alias("dim"), F.col("x").cast("double").alias("x"))


@query("a13_layer_average", oracle([], """select vec_id, dim, round(avg((x-m)/case when s<1e-8 then 1 else s end),6) as x from lay join (select layer, dim, avg(x) as m, stddev_pop(x) as s from lay where train group by 1,2) using (layer, dim) group by 1,2""",
 "lay as (select vec_id, vec_id%5<>0 as train, (i-1)//8 as layer, (i-1)%8 as dim, embedding[i]::double as x from (select vec_id, embedding, unnest(range(1,len(embedding)+1)) as i from embeddings))"))
def a13(spark, sf):
    return A.layer_average(layered(spark, sf), ["vec_id"], "train").select("vec_id", "dim", r6("x", "x"))


@query("a14_center_vectors", "select vec_id, cast(i-1 as bigint) as pos, round(embedding[i]::double - m,6) as x from (select vec_id, embedding, list_avg(list_transform(embedding, lambda x: x::double)) as m, unnest(range(1,len(embedding)+1)) as i from embeddings)")
def a14(spark, sf):
    c = A.center_vectors(vectors(spark, sf), "embedding").select("vec_id", F.posexplode("shape").alias("pos", "x"))
    return c.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("x", "x"))


@query("a15_feature_agreement", oracle(["cohort"], """select m.feature, round(corr(m.a,m.b),6) as r, corr(m.a,m.b)<0.8 as low from cohort, lateral (values ('covariate',covariate,covariate+100*n_lines),('n_digits',n_digits::double,n_digits::double+unit%7),('uniq',uniq,round(uniq,1))) m(feature,a,b) group by 1"""))
def a15(spark, sf):
    a = V.cohort(spark, sf)
    b = a.select("unit", (F.col("covariate") + 100 * F.col("n_lines")).alias("covariate"), (F.col("n_digits") + F.col("unit") % 7).cast("double").alias("n_digits"), F.round("uniq", 1).alias("uniq"))
    r = A.feature_agreement(a.withColumn("n_digits", F.col("n_digits").cast("double")), b, ["unit"], ["covariate", "n_digits", "uniq"])
    return r.select("feature", r6("r", "r"), (F.col("r") < 0.8).alias("low"))


@query("a16_inclusion_funnel", oracle(["cohort"], """select variant, label, n, included, round(pct,6) as pct, round(gap_pp,6) as gap_pp, gap_pp>5 as flag from (select *, max(pct) over (partition by variant)-min(pct) over (partition by variant) as gap_pp from
 (select m.variant, label, count(*) as n, cast(sum(cast(m.inc as int)) as bigint) as included, 100*avg(cast(m.inc as int)) as pct from cohort, lateral (values ('long',covariate>=500),('clean',n_digits<5),('varied',uniq>0.5)) m(variant,inc) group by 1,2))"""))
def a16(spark, sf):
    v = {"long": F.col("covariate") >= 500, "clean": F.col("n_digits") < 5, "varied": F.col("uniq") > 0.5}
    f = A.inclusion_funnel(V.cohort(spark, sf), v, "label", 5.0)
    return f.select("variant", "label", "n", "included", r6("pct", "pct"), r6("gap_pp", "gap_pp"), "flag")


@query("a17_duration_profile", oracle(["slot_rows"], """select slot, linestatus, count(dur) as n, round(quantile_cont(dur,0.25),6) as q25, round(quantile_cont(dur,0.5),6) as median, round(quantile_cont(dur,0.75),6) as q75, count(*) filter (dur<5) as n_short from slot_rows group by 1,2"""))
def a17(spark, sf):
    d = A.duration_profile(V.slot_rows(spark, sf), "dur", ["slot", "linestatus"], 5.0)
    return d.select("slot", "linestatus", "n", *[r6(c, c) for c in ("q25", "median", "q75")], "n_short")


@query("a18_rating_gate", oracle(["cohort"], f"""select variant, count(rating) as n, round(avg(rating),6) as mean, round(avg(cast(rating>=1 as int)),6) as share_ge1, case variant when 'A1' then 0.4::double else 0.75::double end as "limit",
 avg(cast(rating>=1 as int))<=case variant when 'A1' then 0.4::double else 0.75::double end as passed from (select unit, v as variant, {h60_sql('unit', 'v', "'rate'")}%case v when 'A1' then 2 else 4 end as rating from cohort, (select unnest(['A1','A2']) as v)) group by 1"""))
def a18(spark, sf):
    key = K.blind_codes(V.cohort(spark, sf), "unit", ["A1", "A2"], "blind")
    key = key.withColumn("code", F.concat_ws("-", F.col("unit").cast("string"), "letter"))
    rate = h60("unit", "variant", F.lit("rate")) % F.when(F.col("variant") == "A1", 2).otherwise(4)
    sheet = key.select("code", rate.alias("rating"))
    g = A.rating_gate(sheet, key.select("code", "variant"), "code", "variant", "rating", {"A1": 0.4, "A2": 0.75})
    return g.select("variant", "n", r6("mean", "mean"), r6("share_ge1", "share_ge1"), "limit", "passed")


def routes(spark, sf):
    f = fold_auc(spark, sf).filter("arm in ('signal','noise')")
    return f.select("slot", F.when(F.col("repeat") == 0, "old").otherwise("new").alias("protocol"), F.when(F.col("arm") == "signal", "own").otherwise("given").alias("source"), "auc")


@query("a19_decompose", oracle(["predictions"], """select slot, round(oo,6) as old_own, round(og,6) as old_given, round(no,6) as new_own, round(ng,6) as new_given, round((no-oo+ng-og)/2,6) as protocol_effect, round((og-oo+ng-no)/2,6) as source_effect from
 (select slot, avg(auc) filter (repeat=0 and arm='signal') as oo, avg(auc) filter (repeat=0 and arm='noise') as og, avg(auc) filter (repeat>0 and arm='signal') as no, avg(auc) filter (repeat>0 and arm='noise') as ng from fold_auc group by 1)""", FOLD_AUC))
def a19(spark, sf):
    d = A.decompose(routes(spark, sf), "slot", "protocol", "source", "auc", ["old", "new"], ["own", "given"])
    return d.select("slot", *[r6(c, c) for c in d.columns if c != "slot"])


@query("a19_reproduction_gap", oracle(["predictions"], "select count(*) as n, round(max(abs(a.auc-b.auc)),6) as max_abs from fold_auc a join fold_auc b on a.arm=b.arm and a.slot=b.slot and a.fold=b.fold and a.repeat=0 and b.repeat=1", FOLD_AUC))
def a19b(spark, sf):
    f = fold_auc(spark, sf)
    g = A.reproduction_gap(f.filter("repeat = 0"), f.filter("repeat = 1"), ["arm", "slot", "fold"], "auc")
    return g.select("n", r6("max_abs", "max_abs"))


@query("a20_seed_luck", oracle(["predictions"], """select arm, slot, count(*) as n, round(avg(auc),6) as mean, round(stddev_samp(auc),6) as sd, round(min(auc),6) as min, round(max(auc),6) as max, round(100*avg(cast(auc<ref as int)),6) as ref_percentile from
 (select f.*, (select max(auc) from fold_auc r where r.arm=f.arm and r.slot=f.slot and r.repeat=0 and r.fold=0) as ref from fold_auc f) group by 1,2""", FOLD_AUC))
def a20(spark, sf):
    f = fold_auc(spark, sf).select("arm", "slot", (F.col("repeat") * 10 + F.col("fold")).alias("seed"), "auc")
    g = A.seed_luck(f, ["arm", "slot"], "seed", 0, "auc")
    return g.select("arm", "slot", "n", *[r6(c, c) for c in ("mean", "sd", "min", "max", "ref_percentile")])


@query("a21_run_summary", oracle(["predictions"], "select arm, count(auc) as n, round(avg(auc),6) as mean, round(stddev_samp(auc),6) as sd, round(sum(auc),6) as sum from fold_auc group by 1", FOLD_AUC))
def a21(spark, sf):
    g = A.run_summary(fold_auc(spark, sf), "arm", "auc")
    return g.select("arm", "n", r6("mean", "mean"), r6("sd", "sd"), r6("sum", "sum"))


@query("a22_crosstab_margins", oracle(["timebound"], "select case when grouping(segment)=1 then 'All' else segment end as segment, case when grouping(priority)=1 then 'All' else priority end as priority, count(*) as n from timebound group by cube(segment, priority)"))
def a22(spark, sf):
    return A.crosstab_margins(V.timebound(spark, sf), "segment", "priority")


@query("a23_pivot_mean", oracle(["predictions"], "select arm, repeat, " + ", ".join(f'round(avg(prob) filter (slot={i}),6) as "{i}"' for i in SLOTS) + " from predictions group by 1,2"))
def a23(spark, sf):
    g = A.pivot_mean(V.predictions(spark, sf), ["arm", "repeat"], "slot", list(SLOTS), "prob")
    return g.select("arm", "repeat", *[r6(F.col(f"`{c}`"), str(c)) for c in SLOTS])


@query("a24_roll_up_scores", oracle(["predictions"], """select unit, arm, round(avg(l),6) as logit, count(*) as n_recordings, 0 as n_bad from (select unit, arm, slot, avg(ln(greatest(1e-6::double,least(1-1e-6::double,prob))/(1-greatest(1e-6::double,least(1-1e-6::double,prob))))) as l from predictions group by 1,2,3) group by 1,2"""))
def a24(spark, sf):
    g = A.roll_up_scores(V.predictions(spark, sf), ["unit", "arm", "slot"], ["unit", "arm"], "prob")
    return g.select("unit", "arm", r6("logit", "logit"), "n_recordings", "n_bad")


# --- sets -----------------------------------------------------------------------------------------------------------

@query("k01_top_k", oracle(["predictions"], "select arm, slot, round(m,6) as m, rank from (select *, row_number() over (partition by slot order by m desc, arm) as rank from (select arm, slot, round(avg(auc),9) as m from fold_auc group by 1,2)) where rank<=2", FOLD_AUC))
def k01(spark, sf):
    m = fold_auc(spark, sf).groupBy("arm", "slot").agg(F.round(F.avg("auc"), 9).alias("m"))
    return K.top_k(m, ["slot"], [F.desc("m"), "arm"], 2).select("arm", "slot", r6("m", "m"), F.col("rank").cast("long").alias("rank"))


@query("k01_top_k_global", "select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 15")
def k01b(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return K.top_k_global(li, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 15)


@query("k02_sample_units", oracle(["cohort"], f"select stratum, unit from (select stratum, unit, row_number() over (partition by stratum order by {h60_sql('unit', chr(39) + 'samp' + chr(39), 'stratum')}, unit) as rn from cohort) where rn<=10"))
def k02(spark, sf):
    return K.sample_units(V.cohort(spark, sf).select("stratum", "unit"), "unit", 10, "samp", ["stratum"])


@query("k03_same_units", oracle(["predictions"], f"""select repeat, fold, slot, count(*) as n_arms, count(distinct n_units||'-'||digest) as n_sets from (select repeat, fold, slot, arm, count(*) as n_units, sum({h60_sql('unit')}) as digest from (select distinct repeat, fold, slot, arm, unit from predictions) group by 1,2,3,4) group by 1,2,3"""))
def k03(spark, sf):
    return K.same_units(V.predictions(spark, sf), "arm", ["repeat", "fold", "slot"], "unit")


@query("k03_union_relabel", "select source, count(*) as n from (select 'customer' as source, c_nationkey as k from customer union all select 'supplier', s_nationkey from supplier) group by 1")
def k03b(spark, sf):
    u = K.union_relabel({"customer": V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), "supplier": V.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))})
    return u.groupBy("source").agg(N())


@query("k04_common_units", oracle(["predictions"], "select count(*) as n, cast(sum(unit) as bigint) as total from (select unit from predictions where arm='signal' and slot=1 intersect select unit from predictions where arm='noise' and slot=2)"))
def k04(spark, sf):
    p = V.predictions(spark, sf)
    c = K.common_units(p.filter("arm = 'signal' and slot = 1"), p.filter("arm = 'noise' and slot = 2"), "unit")
    return c.agg(N(), F.sum("unit").alias("total"))


@query("k05_distinct_entities", "select o_custkey, nk, seg from (select o_custkey, max(c_nationkey) as nk, max(c_mktsegment) as seg from orders join customer on o_custkey=c_custkey group by 1 having count(distinct c_nationkey)=1 and count(distinct c_mktsegment)=1)")
def k05(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("seg"))
    t = V.table(spark, sf, "orders").select("o_custkey").join(c, "o_custkey")
    bad = K.inconsistent_entities(t, "o_custkey", ["nk", "seg"])
    return K.distinct_entities(t.join(bad.select("o_custkey"), "o_custkey", "left_anti"), "o_custkey", ["nk", "seg"])


@query("k06_eligible_units", oracle(["slot_rows"], """select entity, slot, dur from slot_rows where slot in (1,3) and entity in (select entity from slot_rows group by 1 having min(dur)>=3 and count(distinct slot)>=7 order by 1 limit 20)"""))
def k06(spark, sf):
    return K.eligible_units(V.slot_rows(spark, sf).select("entity", "slot", "dur"), "entity", "slot", "dur", V.SLOTS, 3.0, 20, [1, 3])


@query("k07_blind_codes", oracle(["cohort"], f"select unit, v as variant, substr('ABCDEFGH', cast(row_number() over (partition by unit order by {h60_sql('unit', 'v', chr(39) + 'blind' + chr(39))}, v) as int), 1) as letter from cohort, (select unnest(['A1','A2','full']) as v)"))
def k07(spark, sf):
    return K.blind_codes(V.cohort(spark, sf), "unit", ["A1", "A2", "full"], "blind")


# --- association ----------------------------------------------------------------------------------------------------

@query("t01_chi2_test", oracle(["timebound"], "select * from (select variable as pair, n, dof, round(chi2,6) as chi2 from chi)",
 """cells as (select 'segment' as variable, segment as value, label, count(*) as n from timebound group by 1,2,3 union all
 select 'half', case when start_hour<12 then 'AM' else 'PM' end, label, count(*) from timebound where start_hour is not null group by 1,2,3),""" + CHI_SQL))
def t01(spark, sf):
    t = V.timebound(spark, sf)
    h = t.withColumn("half", F.when(F.col("start_hour") < 12, "AM").when(F.col("start_hour") >= 12, "PM"))
    a = T.chi2_test(t, "segment", "label").withColumn("pair", F.lit("segment"))
    return a.unionByName(T.chi2_test(h, "half", "label").withColumn("pair", F.lit("half"))).withColumn("chi2", r6("chi2"))


@query("t02_fisher_exact", oracle(["cohort"], """select stratum, a, b, c, d, round(sum(case when lp<=lo+1e-7 then exp(lp-top) else 0 end)/sum(exp(lp-top)),6) as p from
 (select *, max(lp) over (partition by stratum) as top, max(case when x=a then lp end) over (partition by stratum) as lo from
  (select *, -(lgamma(x+1)+lgamma(a+b-x+1)+lgamma(a+c-x+1)+lgamma(d-a+x+1)) as lp from (select *, unnest(range(greatest(0,a-d), least(a+c,a+b)+1)) as x from t))) group by all""",
 "t as (select stratum, count(*) filter (toxic=1 and label=1) as a, count(*) filter (toxic=1 and label=0) as b, count(*) filter (toxic=0 and label=1) as c, count(*) filter (toxic=0 and label=0) as d from cohort where toxic is not null and label is not null group by 1)"))
def t02(spark, sf):
    c = V.cohort(spark, sf)
    return T.fisher_exact(c, "toxic", "label", ["stratum"]).withColumn("p", r6("p"))


MW_SQL = """rk as (select stratum, label, score, rank() over (partition by stratum order by score)::double+(count(*) over (partition by stratum, score)-1)/2.0::double as r, count(*) over (partition by stratum, score)::double as t from cohort),
mw as (select stratum, count(*) filter (label=1) as n1, count(*) filter (label=0) as n0, sum(case when label=1 then r else 0 end)-count(*) filter (label=1)*(count(*) filter (label=1)+1)/2.0::double as u, sum(t*t-1) as tie, count(*)::double as n from rk group by 1)"""


@query("t03_mann_whitney", oracle(["cohort"], """select stratum, n1, n0, round(u,6) as u, round(sign(u-n1*n0/2.0::double)*greatest(0,abs(u-n1*n0/2.0::double)-0.5)/sqrt(n1::double*n0/12.0::double*((n+1)-tie/(n*(n-1)))),6) as z from mw""", MW_SQL))
def t03(spark, sf):
    m = T.mann_whitney(V.cohort(spark, sf), "score", "label", ["stratum"])
    return m.select("stratum", "n1", "n0", r6("u", "u"), r6("z", "z"))


@query("t04_spearman", oracle(["cohort"], """select stratum, count(*) as n, round(corr(rx,ry),6) as rho from (select stratum, rank() over (partition by stratum order by score)::double+(count(*) over (partition by stratum, score)-1)/2.0::double as rx,
 rank() over (partition by stratum order by covariate)::double+(count(*) over (partition by stratum, covariate)-1)/2.0::double as ry from cohort) group by 1"""))
def t04(spark, sf):
    return T.spearman(V.cohort(spark, sf), "score", "covariate", ["stratum"]).withColumn("rho", r6("rho"))


@query("w01_midrank", oracle(["cohort"], "select unit, stratum, rank() over (partition by stratum order by n_digits)::double+(count(*) over (partition by stratum, n_digits)-1)/2.0::double as rank from cohort"))
def w01(spark, sf):
    from ..operators.ordered import midrank

    return midrank(V.cohort(spark, sf).select("unit", "stratum", "n_digits"), "n_digits", ["stratum"]).select("unit", "stratum", "rank")


PB = 1000


@query("t05_auc_envelope", oracle(["cohort"], """select (select cast(sum(label) as bigint) from cohort) as n1, (select cast(sum(1-label) as bigint) from cohort) as n0, round((select auc from full_auc),6) as auc, count(auc) as n_ok, round(quantile_cont(auc,0.003),6) as ci_low, round(quantile_cont(auc,0.997),6) as ci_high,
 not ((select auc from full_auc) between quantile_cont(auc,0.003) and quantile_cont(auc,0.997)) as beyond_chance from perm_auc""",
 f"""cb as (select unit, covariate, {h60_sql('unit', "'env'")} as code, unnest(range(0,{PB})) as b from cohort),
 dr as (""" + draws_sql("code", "b", "cb", "unit, covariate, b") + """),
 perm as (select b, case when row_number() over (partition by b order by x, unit) <= (select sum(label) from cohort) then 1 else 0 end as label, covariate as score from dr),
 perm_auc as (""" + auc_sql("perm", "b", digits=None) + "), full_auc as (" + auc_sql("(select label, covariate as score from cohort) q", "", digits=None) + ")"))
def t05(spark, sf):
    e = T.auc_envelope(V.cohort(spark, sf), "covariate", "label", "unit", PB, "env")
    return e.select("n1", "n0", r6("auc", "auc"), "n_ok", r6("ci_low", "ci_low"), r6("ci_high", "ci_high"), "beyond_chance")


@query("t06_tails")
def t06(spark, sf):
    """Tail probabilities on result rows: Mann-Whitney z, chi-square and a t per stratum."""
    m = T.mann_whitney(V.cohort(spark, sf), "score", "label", ["stratum"])
    return m.select("stratum", r6("z", "z"), r6(2 * norm_sf(F.abs("z")), "p_norm"), r6(chi2_sf(F.col("z") * F.col("z"), F.lit(1.0)), "p_chi2"),
                    r6(2 * t_sf(F.abs("z"), (F.col("n1") + F.col("n0") - 2).cast("double")), "p_t"))
