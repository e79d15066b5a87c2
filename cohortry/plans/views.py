"""Role views over the given tables, in Spark and (for the oracles) in DuckDB SQL. Definitions follow FIXTURES.md part B."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import h60, h60_sql, u01, u01_sql
from ..session import shared
from ..operators.ordered import bucketed_prefix, BUCKET

SLOTS = 7
ARMS = ("signal", "context", "noise")
REPEATS = 3
FOLDS = 5
_TABLES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    key = (id(spark), sf, name)
    if key not in _TABLES:  # keeps the resolved schema, so the footers are read once per session
        _TABLES[key] = spark.read.parquet(f"{sf}/{name}.parquet")
    return _TABLES[key]


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    """documents x labels: one row per unit, score from text statistics of the whole text.

    This is the hand-off table every evaluation query starts from, so it is persisted (disk-backed, a few numeric columns
    per unit): the pass over the texts then runs once per query instead of once per branch of the plan.
    """
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    words = F.split("text", " ")
    doc = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.translate("text", "0123456789", ""))).cast("long").alias("n_digits"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("uniq"),
    )
    z = 3 * F.col("uniq") + 0.1 * F.ln(1 + F.col("n_digits").cast("double")) - 0.1 * F.ln(1 + F.col("n_lines").cast("double")) - F.lit(1.5)
    return shared(lab.join(doc, "doc_id").select(
        F.col("doc_id").alias("unit"), F.col("quality").cast("long").alias("label"), F.col("toxic").cast("long").alias("toxic"),
        F.col("lang").alias("stratum"), F.col("source").alias("cluster"), F.col("n_chars").cast("double").alias("covariate"),
        "n_lines", "n_digits", F.round(F.col("uniq"), 6).alias("uniq"),
        F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6).alias("score"),
    ))


def timebound(spark: SparkSession, sf: str) -> DataFrame:
    """orders x customer: cases over the whole period, controls only before the cut date."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    o = o.filter((F.col("o_orderstatus") == "O") | ((F.col("o_orderstatus") == "F") & (F.col("day") < F.lit("1999-06-01").cast("date"))))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    lab = F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).cast("long")
    hour = F.when(F.col("o_custkey") % 97 != 0, (F.col("o_custkey") % 12 + 8).cast("double"))
    return o.join(c, "o_custkey").select(
        F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("cust"), lab.alias("label"), "day",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("age"), hour.alias("start_hour"),
        F.datediff("day", F.lit("1995-01-01").cast("date")).cast("double").alias("days"),
        F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"),
        F.round(0.6 * u01("o_orderkey", F.lit("ts")) + 0.25 * lab + 0.15 * F.coalesce(hour, F.lit(14.0)) / 20.0, 6).alias("score"),
    )


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Cohort keys spread by unit before the fan-out: later aggregations that contain the unit need no further shuffle."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return cohort(spark, sf).select("unit", "label", "stratum", "cluster").repartition(n, "unit")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """unit x slot x arm x repeat test predictions; a slot is missing for all arms of a unit together."""
    c = units(spark, sf)
    t = c.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(SLOTS)))).filter(h60("unit", "slot", F.lit("miss")) % 50 != 0)
    t = t.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    t = t.withColumn("fold", h60("unit", "repeat", F.lit("fold")) % FOLDS)
    t = t.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ARMS])))
    return _with_prob(t, u01("unit", "arm", "slot", "repeat"))


def _with_prob(t: DataFrame, u) -> DataFrame:
    p = (
        F.when(F.col("arm") == "signal", 0.7 * u + 0.3 * F.col("label"))
        .when(F.col("arm") == "context", 0.7 * u + F.when(F.col("stratum") == "en", 0.3).otherwise(0.0))
        .otherwise(u)
    )
    return t.select(
        "unit", "label", "stratum", "cluster", "arm", F.col("slot").cast("long").alias("slot"),
        F.col("repeat").cast("long").alias("repeat"), F.col("fold").cast("long").alias("fold"), p.alias("prob"),
    )


def fold_roles(spark: SparkSession, sf: str, keep: Sequence[Column] = ()) -> DataFrame:
    """Role table that belongs to `predictions`: (unit, repeat, fold) -> role, inner_fold. `keep` are columns made once per unit."""
    c = units(spark, sf).select("*", *keep)
    t = c.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    t = t.withColumn("own", h60("unit", "repeat", F.lit("fold")) % FOLDS)
    t = t.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    test = F.col("own") == F.col("fold")
    return t.select(
        "unit", "label", "stratum", "cluster", F.col("repeat").cast("long").alias("repeat"), F.col("fold").cast("long").alias("fold"),
        F.when(test, "test").otherwise("train").alias("role"),
        F.when(test, F.lit(-1)).otherwise(h60("unit", "repeat", "fold", F.lit("inner")) % 5).cast("long").alias("inner_fold"), *c.columns[4:],
    )


def inner_preds(spark: SparkSession, sf: str) -> DataFrame:
    """Inner out-of-fold predictions: one row per train unit of every outer fold."""
    slots = F.filter(F.sequence(F.lit(1), F.lit(SLOTS)), lambda s: h60("unit", s, F.lit("miss")) % 50 != 0)
    t = fold_roles(spark, sf, [slots.alias("slots")]).filter(F.col("role") == "train").drop("role", "inner_fold")
    t = t.withColumn("slot", F.explode("slots"))
    t = t.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ARMS])))
    return _with_prob(t, u01("unit", "arm", "slot", "repeat", "fold"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Per-user event series as 'frames': t = row index in (ts, event_id) order, level = ln(value), minus infinity at 0 (Spark's ln gives NULL there)."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    e = e.withColumn(BUCKET, F.date_trunc("day", "ts"))
    e = bucketed_prefix(e, ["user_id"], ["ts", "event_id"], {"t": F.lit(1).cast("long")})
    return e.select(
        F.col("user_id").alias("rec"), F.col("t").cast("long").alias("t"), F.when(F.col("value") == 0, float("-inf")).otherwise(F.ln("value")).alias("level"), "value",
        F.col("event_type").isin("view", "click").alias("voiced"),
    )


def slot_rows(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as recordings: entity = order, slot = line number."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("entity"), F.col("l_linenumber").cast("long").alias("slot"),
        F.when(F.col("l_returnflag") == "A", "x").otherwise("y").alias("chain"), F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("dur"), F.col("l_extendedprice").alias("level"), F.col("l_linestatus").alias("linestatus"),
        F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("disc"), F.col("l_partkey").alias("partkey"),
    )


SQL_VIEWS: dict[str, str] = {
    "cohort": """
select unit, label, toxic, stratum, cluster, covariate, n_lines, n_digits, round(uniq_raw, 6) as uniq,
  round(1.0::double/(1.0::double+exp(-(3*uniq_raw + 0.1::double*ln(1+n_digits::double) - 0.1::double*ln(1+n_lines::double) - 1.5::double))),6) as score
from (select d.doc_id as unit, cast(quality as bigint) as label, cast(toxic as bigint) as toxic, lang as stratum, source as cluster,
        n_chars::double as covariate, cast(length(text)-length(replace(text, chr(10), '')) as bigint) as n_lines,
        cast(length(text)-length(translate(text,'0123456789','')) as bigint) as n_digits,
        len(list_distinct(string_split(text,' ')))::double/len(string_split(text,' '))::double as uniq_raw
      from documents d join labels l on d.doc_id=l.doc_id)""",
    "timebound": f"""
select unit, cust, label, day, age, start_hour, date_diff('day', date '1995-01-01', day)::double as days, segment, priority,
  round(0.6::double*{u01_sql('unit', "'ts'")} + 0.25::double*label + 0.15::double*coalesce(start_hour,14.0::double)/20.0::double,6) as score
from (select o_orderkey as unit, o_custkey as cust, cast(case when o_orderstatus='O' then 1 else 0 end as bigint) as label,
        cast(o_orderdate as date) as day, case when c_acctbal>=0 then c_acctbal end as age,
        case when o_custkey % 97 <> 0 then (o_custkey % 12 + 8)::double end as start_hour, c_mktsegment as segment, o_orderpriority as priority
      from orders join customer on o_custkey=c_custkey
      where o_orderstatus='O' or (o_orderstatus='F' and o_orderdate < timestamp '1999-06-01'))""",
    "fold_roles": f"""
select unit, label, stratum, cluster, r as repeat, k as fold, case when own=k then 'test' else 'train' end as role,
  cast(case when own=k then -1 else {h60_sql('unit', 'r', 'k', "'inner'")} % 5 end as bigint) as inner_fold
from (select unit, label, stratum, cluster, r, {h60_sql('unit', 'r', "'fold'")} % {FOLDS} as own
      from cohort, (select unnest(range(0,{REPEATS})) as r)), (select unnest(range(0,{FOLDS})) as k)""",
    "predictions": f"""
select unit, label, stratum, cluster, arm, slot, r as repeat, {h60_sql('unit', 'r', "'fold'")} % {FOLDS} as fold,
  (case arm when 'signal' then 0.7::double*{u01_sql('unit', 'arm', 'slot', 'r')}+0.3::double*label
    when 'context' then 0.7::double*{u01_sql('unit', 'arm', 'slot', 'r')}+case when stratum='en' then 0.3::double else 0 end
    else {u01_sql('unit', 'arm', 'slot', 'r')} end) as prob
from cohort, (select unnest(range(1,{SLOTS + 1})) as slot), (select unnest(range(0,{REPEATS})) as r), (select unnest(['signal','context','noise']) as arm)
where {h60_sql('unit', 'slot', "'miss'")} % 50 <> 0""",
    "inner_preds": f"""
select unit, label, stratum, cluster, arm, slot, repeat, fold,
  (case arm when 'signal' then 0.7::double*{u01_sql('unit', 'arm', 'slot', 'repeat', 'fold')}+0.3::double*label
    when 'context' then 0.7::double*{u01_sql('unit', 'arm', 'slot', 'repeat', 'fold')}+case when stratum='en' then 0.3::double else 0 end
    else {u01_sql('unit', 'arm', 'slot', 'repeat', 'fold')} end) as prob
from (select * from fold_roles where role='train'), (select unnest(range(1,{SLOTS + 1})) as slot), (select unnest(['signal','context','noise']) as arm)
where {h60_sql('unit', 'slot', "'miss'")} % 50 <> 0""",
    "frames": """
select user_id as rec, row_number() over (partition by user_id order by ts, event_id) - 1 as t, ln(value) as level, value,
  event_type in ('view','click') as voiced from events""",
    "slot_rows": """
select l_orderkey as entity, cast(l_linenumber as bigint) as slot, case when l_returnflag='A' then 'x' else 'y' end as chain, l_shipdate as ts,
  l_quantity as dur, l_extendedprice as level, l_linestatus as linestatus, l_returnflag as flag, l_discount as disc, l_partkey as partkey from lineitem""",
    "grid": f"""
select e.entity, e.slot, coalesce(n,0) as n, case when n is null then 'MISSING' when n=1 then 'OK' else 'MULTIPLE' end as status
from (select o_orderkey as entity, slot from orders, (select unnest(range(1,{SLOTS + 1})) as slot)) e
left join (select entity, slot, count(*) as n from slot_rows group by 1,2) f on e.entity=f.entity and e.slot=f.slot""",
    "pooled": """
select arm, unit, any_value(label) as label, any_value(stratum) as stratum, any_value(cluster) as cluster, avg(prob) as prob_raw, round(avg(prob),6) as prob
from (select arm, repeat, unit, any_value(label) as label, any_value(stratum) as stratum, any_value(cluster) as cluster, avg(prob) as prob from predictions group by 1,2,3) group by 1,2""",
    "fused": """
select arm, repeat, fold, unit, any_value(label) as label, any_value(stratum) as stratum, any_value(cluster) as cluster, round(avg(prob),6) as prob
from predictions group by 1,2,3,4""",
}

VIEW_NEEDS: dict[str, tuple[str, ...]] = {
    "predictions": ("cohort",),
    "fold_roles": ("cohort",),
    "inner_preds": ("fold_roles",),
    "grid": ("slot_rows",),
    "pooled": ("predictions",),
    "fused": ("predictions",),
}
