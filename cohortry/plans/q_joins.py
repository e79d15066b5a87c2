"""Queries for joins (J rows) and M26."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import joins as J
from ..operators import metrics as M
from . import views as V
from .q_metrics import COST, FOLD_AUC, SELECT_SQL, fold_auc
from .registry import oracle, query


def N():
    return F.count(F.lit(1)).cast("long").alias("n")
SLOTS = list(range(1, V.SLOTS + 1))


def orders(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("cust"))


def grid(spark, sf):
    return J.complete_grid(orders(spark, sf), V.slot_rows(spark, sf), "entity", "slot", SLOTS)


@query("j01_complete_grid", oracle(["grid"], "select slot, status, count(*) as n, cast(sum(n) as bigint) as facts from grid group by 1,2"))
def j01(spark, sf):
    return grid(spark, sf).groupBy("slot", "status").agg(N(), F.sum("n").cast("long").alias("facts"))


@query("j02_join_unique", oracle(["grid"], """select g.slot, count(*) as n, count(u.dur) as n_attached, round(sum(u.dur),2) as dur from grid g left join
 (select entity, slot, max(dur) as dur from slot_rows group by 1,2 having count(*)=1) u on g.entity=u.entity and g.slot=u.slot group by 1"""))
def j02(spark, sf):
    t = J.join_unique(grid(spark, sf).select("entity", "slot"), V.slot_rows(spark, sf), ["entity", "slot"], ["dur"])
    return t.groupBy("slot").agg(N(), F.count("dur").cast("long").alias("n_attached"), F.round(F.sum("dur"), 2).alias("dur"))


@query("j03_restrict_unmatched", oracle(["timebound", "slot_rows"], """select 'restricted' as part, count(*) as n from slot_rows where entity in (select unit from timebound)
 union all select 'unmatched', count(*) from slot_rows where entity not in (select unit from timebound)"""))
def j03(spark, sf):
    s, t = V.slot_rows(spark, sf), V.timebound(spark, sf).select(F.col("unit").alias("entity"))
    return J.restrict(s, t, ["entity"]).agg(F.lit("restricted").alias("part"), N()).unionByName(J.unmatched(s, t, ["entity"]).agg(F.lit("unmatched").alias("part"), N()))


@query("j04_key_diff", oracle(["slot_rows"], """select 'left_only' as side, count(*) as n from orders where o_orderkey not in (select entity from slot_rows)
 union all select 'right_only', count(distinct entity) from slot_rows where entity not in (select o_orderkey from orders)"""))
def j04(spark, sf):
    d = J.key_diff(orders(spark, sf), V.slot_rows(spark, sf), ["entity"])
    return d.agg(*[F.count_if(F.col("side") == s).cast("long").alias(s) for s in ("left_only", "right_only")]).unpivot([], ["left_only", "right_only"], "side", "n")


@query("j05_join_checked", """select 'joined' as what, (select count(*) from orders left join customer on o_custkey=c_custkey) as n
 union all select 'violations_many_to_one', (select count(*) from (select c_custkey from customer group by 1 having count(*)>1))
 union all select 'violations_one_to_one', (select count(*) from (select o_custkey from orders group by 1 having count(*)>1))""")
def j05(spark, sf):
    a = orders(spark, sf)
    b = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), "c_acctbal")
    out, v1 = J.join_checked(a, b, ["cust"], "many_to_one")
    _, v2 = J.join_checked(a, b, ["cust"], "one_to_one")
    return out.agg(F.lit("joined").alias("what"), N()).unionByName(v1.agg(F.lit("violations_many_to_one").alias("what"), N())).unionByName(v2.agg(F.lit("violations_one_to_one").alias("what"), N()))


@query("j06_attach", "select n_name, count(*) as n, round(sum(c_acctbal),2) as bal from customer left join nation on c_nationkey=n_nationkey group by 1")
def j06(spark, sf):
    dim = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.attach(V.table(spark, sf, "customer"), dim, "c_nationkey").groupBy("n_name").agg(N(), F.round(F.sum("c_acctbal"), 2).alias("bal"))


def versions(spark, sf):
    """customer and an edited copy: balances shifted on every 13th key, segment replaced and rows swapped on every 17th."""
    a = V.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    b = a.withColumn("c_acctbal", F.when(k % 13 == 0, F.col("c_acctbal") + 1.5).otherwise(F.col("c_acctbal")))
    b = b.withColumn("c_mktsegment", F.when(k % 17 == 0, "OTHER").otherwise(F.col("c_mktsegment")))
    return a, b


VERSIONS = """va as (select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer),
vb as (select c_custkey, c_nationkey, case when c_custkey%13=0 then c_acctbal+1.5 else c_acctbal end as c_acctbal, case when c_custkey%17=0 then 'OTHER' else c_mktsegment end as c_mktsegment from customer where c_custkey<>5)"""


@query("j07_table_diff", oracle([], """select c."column", c.n_diff, (select count(*) from va where c_custkey not in (select c_custkey from vb)) as rows_left_only, 0 as rows_right_only, (select count(*) from va) as rows from
 (select 'c_nationkey' as "column", count(*) filter (va.c_nationkey is distinct from vb.c_nationkey) as n_diff from va join vb using (c_custkey) union all
  select 'c_acctbal', count(*) filter (va.c_acctbal is distinct from vb.c_acctbal) from va join vb using (c_custkey) union all
  select 'c_mktsegment', count(*) filter (va.c_mktsegment is distinct from vb.c_mktsegment) from va join vb using (c_custkey)) c""", VERSIONS))
def j07(spark, sf):
    a, b = versions(spark, sf)
    return J.table_diff(a, b.filter("c_custkey <> 5"), "c_custkey", ["c_nationkey", "c_acctbal", "c_mktsegment"])


@query("j08_field_agreement", oracle([], """select f.field, f.n, round(f.agreement,6) as agreement, round(c.chance,6) as chance from
 (select 'c_nationkey' as field, count(*) as n, avg(cast(abs(va.c_nationkey-vb.c_nationkey)<=0.001 as int)) as agreement from va join vb using (c_custkey) union all
  select 'c_acctbal', count(*), avg(cast(abs(va.c_acctbal-vb.c_acctbal)<=0.001 as int)) from va join vb using (c_custkey) union all
  select 'c_mktsegment', count(*), avg(cast(va.c_mktsegment=vb.c_mktsegment as int)) from va join vb using (c_custkey)) f join
 (select 'c_nationkey' as field, sum(k*k)::double/(sum(k)*sum(k))::double as chance from (select count(*) as k from va group by c_nationkey) union all
  select 'c_acctbal', sum(k*k)::double/(sum(k)*sum(k))::double from (select count(*) as k from va group by c_acctbal) union all
  select 'c_mktsegment', sum(k*k)::double/(sum(k)*sum(k))::double from (select count(*) as k from va group by c_mktsegment)) c using (field)""", VERSIONS))
def j08(spark, sf):
    a, b = versions(spark, sf)
    t = J.field_agreement(a, b.filter("c_custkey <> 5"), "c_custkey", ["c_nationkey", "c_acctbal", "c_mktsegment"], 0.001)
    return t.select("field", "n", r6("agreement", "agreement"), r6("chance", "chance"))


@query("j09_ownership_trace", oracle([], """select outcome, owner_label, row_label, count(*) as n from
 (select r.lab as row_label, case when exists (select 1 from oa where oa.id=r.id and oa.bal=r.bal and oa.nat=r.nat) then 'own' when o.l0 is not null then 'other' else 'nobody' end as outcome,
   case when exists (select 1 from oa where oa.id=r.id and oa.bal=r.bal and oa.nat=r.nat) then r.lab when o.l0=o.l1 then o.l0 when o.l0 is not null then 'mixed' else 'none' end as owner_label
  from ob r left join (select bal, nat, min(lab) as l0, max(lab) as l1 from oa group by 1,2) o on o.bal=r.bal and o.nat=r.nat) group by 1,2,3""",
 """oa as (select c_custkey as id, case when c_acctbal>=0 then 'pos' else 'neg' end as lab, round(c_acctbal,2) as bal, c_nationkey as nat from customer),
 ob as (select case when c_custkey%17=0 then c_custkey+1 when c_custkey%17=1 then c_custkey-1 else c_custkey end as id, case when c_acctbal>=0 then 'pos' else 'neg' end as lab,
   round(case when c_custkey%13=0 then c_acctbal+100000 else c_acctbal end,2) as bal, c_nationkey as nat from customer)"""))
def j09(spark, sf):
    k = F.col("c_custkey")
    a = V.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, "pos").otherwise("neg").alias("lab"), "c_acctbal", "c_nationkey")
    b = a.withColumn("c_acctbal", F.when(k % 13 == 0, F.col("c_acctbal") + 100000).otherwise(F.col("c_acctbal")))
    b = b.withColumn("c_custkey", F.when(k % 17 == 0, k + 1).when(k % 17 == 1, k - 1).otherwise(k))
    return J.ownership_trace(a, b, "c_custkey", "lab", ["c_acctbal", "c_nationkey"])


@query("j10_apply_selection", oracle(["predictions", "inner_preds"], """select p.repeat, p.fold, p.arm, count(*) as n, round(sum(prob),6) as total from predictions p join picked s on p.repeat=s.repeat and p.fold=s.fold and p.arm=s.selected group by 1,2,3""", SELECT_SQL))
def j10(spark, sf):
    sel = M.select_per_fold(V.inner_preds(spark, sf), "label", "prob", "arm", COST)
    return J.apply_selection(V.predictions(spark, sf), sel).groupBy("repeat", "fold", "arm").agg(N(), F.round(F.sum("prob"), 6).alias("total"))


@query("j11_delta_vs_baseline", oracle(["predictions"], """select f.arm, f.slot, f.repeat, f.fold, round(f.auc,6) as auc, round(b.auc,6) as baseline, round(f.auc-b.auc,6) as delta from fold_auc f left join (select * from fold_auc where arm='noise') b
 on f.slot=b.slot and f.repeat=b.repeat and f.fold=b.fold""", FOLD_AUC))
def j11(spark, sf):
    f = fold_auc(spark, sf).select("arm", "slot", "repeat", "fold", "auc")
    return J.delta_vs_baseline(f, ["slot", "repeat", "fold"], "arm", "noise", "auc").withColumns({c: r6(c) for c in ("auc", "baseline", "delta")})


def vectors(spark, sf):
    return V.table(spark, sf, "embeddings").select("vec_id", "embedding", "label", (F.col("vec_id") % 100).alias("entity"), (F.col("vec_id") % 7).alias("slot"))


PAIR_SQL = """e as (select id, entity, n, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y*y)))) as u from
 (select id, entity, n, list_transform(v, lambda x: x - list_avg(v)) as c from
  (select min(vec_id) as id, vec_id%100 as entity, count(*) as n, list_transform(embedding, lambda x: x::double) as v from embeddings group by embedding, vec_id%100))),
 pr as (select a.id as a, b.id as b, a.n*b.n as n_pairs, round(list_dot_product(a.u,b.u),6) as corr from e a join e b on a.id<b.id and a.entity<>b.entity)"""


@query("j12_near_duplicates", oracle([], "select a, b, n_pairs, corr from pr order by corr desc, a, b limit 50", PAIR_SQL))
def j12(spark, sf):
    return J.near_duplicates(vectors(spark, sf), "vec_id", "embedding", "entity")


@query("j12_similarity_summary", oracle([], """select (select cast(sum(n_pairs) as bigint) from pr) as pairs, (select coalesce(cast(sum(n_pairs) as bigint),0) from pr where corr>=0.5) as flagged,
 (select min(bin)/1000.0::double from (select floor(corr*1000) as bin, sum(sum(n_pairs)) over (order by floor(corr*1000)) as cum, sum(sum(n_pairs)) over () as tot from pr group by 1) where cum>=ceil(tot*0.99)) as q_bin,
 (select min(corr) from (select corr, sum(sum(n_pairs)) over (order by corr) as cum, sum(sum(n_pairs)) over () as tot from pr group by 1) where cum>=ceil(tot*0.99)) as q_corr""", PAIR_SQL))
def j12b(spark, sf):
    return J.similarity_summary(vectors(spark, sf), "vec_id", "embedding", "entity", 0.5)


@query("m26_entity_similarity", oracle([], """select count(*) filter (same) as pairs_same, count(*) filter (not same) as pairs_other, round(avg(case when same then sim end),6) as mean_same, round(avg(case when not same then sim end),6) as mean_other,
 round((sum(case when same then rk else 0 end)-count(*) filter (same)*(count(*) filter (same)+1)/2.0::double)/(count(*) filter (same)::double*count(*) filter (not same)::double),6) as auc
 from (select *, rank() over (order by sim)::double+(count(*) over (partition by sim)-1)/2.0::double as rk from
  (select a.entity=b.entity as same, round(list_dot_product(a.u,b.u),4) as sim from w a join w b on a.vec_id<b.vec_id and a.slot<>b.slot))""",
 """d as (select vec_id, i, embedding[i]::double as x from embeddings, (select unnest(range(1,(select cast(max(len(embedding)) as bigint)+1 from embeddings))) as i)),
 z as (select vec_id, i, (x-avg(x) over (partition by i))/stddev_pop(x) over (partition by i) as z from d),
 w as (select vec_id, vec_id%100 as entity, vec_id%7 as slot, list(z/nz order by i) as u from (select *, sqrt(sum(z*z) over (partition by vec_id)) as nz from z) group by 1)"""))
def m26(spark, sf):
    s = J.entity_similarity(vectors(spark, sf), "vec_id", "embedding", "entity", "slot")
    return s.select("pairs_same", "pairs_other", r6("mean_same", "mean_same"), r6("mean_other", "mean_other"), r6("auc", "auc"))


def digests(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"), F.col("source").alias("entity"))


@query("j13_exact_duplicates", """select digest, cast(sum(k) as bigint) as n, count(*) as n_entities, max(k) as max_in_entity, count(*)>1 as across_entities, max(k)>1 as within_entity from
 (select md5(text) as digest, source, count(*) as k from documents group by 1,2) group by 1 having sum(k)>1""")
def j13(spark, sf):
    return J.exact_duplicates(digests(spark, sf), "digest", "entity")


@query("j14_identity_collisions", oracle(["timebound"], """select day, segment, count(*) as n, count(*) filter (label=1) as n1, count(*) filter (label=0) as n0, min(unit) as first_id, max(unit) as last_id, month(day)=1 and day(day)=1 as placeholder
 from timebound group by 1,2 having count(*)>1"""))
def j14(spark, sf):
    return J.identity_collisions(V.timebound(spark, sf), "day", "segment", "unit", "label")


@query("j14_identity_members", oracle(["timebound"], "select label, count(*) as n from timebound t join (select day, segment from timebound group by 1,2 having count(*)>1) g on t.day=g.day and t.segment=g.segment group by 1"))
def j14b(spark, sf):
    return J.identity_members(V.timebound(spark, sf), "day", "segment", "unit", "label").groupBy("label").agg(N())


@query("j15_exclusion_closure", oracle(["timebound"], """select count(*) as n_left, count(*) filter (label=1) as n1, count(*) filter (label=0) as n0, (select count(*) from timebound) as n_all,
 count(*)*2>=(select count(*) from timebound) and count(*) filter (label=1)>0 and count(*) filter (label=0)>0 as ok
 from timebound where day not in (select day from timebound where score>0.9)"""))
def j15(spark, sf):
    t = V.timebound(spark, sf)
    ex = J.exclusion_closure(t, t.filter("score > 0.9"), "unit", "day")
    return J.closure_guard(t, ex, "unit", "label")
