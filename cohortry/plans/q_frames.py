"""Queries for ordered frame analytics (W rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import frames as W
from ..session import shared
from . import views as V
from .q_joins import N
from .registry import oracle, query

HOP, WIN, MARGIN = 0.010, 0.025, 0.10


def frames(spark, sf):
    return shared(V.frames(spark, sf))


@query("w02_informative_strata", oracle(["timebound"], "select day, label, count(*) as n, round(max(m),6) as cell_mean from (select day, label, avg(label) over (partition by day) as m, min(label) over (partition by day) as lo, max(label) over (partition by day) as hi from timebound) where lo<>hi group by 1,2"))
def w02(spark, sf):
    t = W.informative_strata(V.timebound(spark, sf), ["day"], "label")
    return t.groupBy("day", "label").agg(N(), r6(F.max("cell_mean"), "cell_mean"))


@query("w03_dilate", oracle(["frames"], "select rec, t, bool_or(voiced) over (partition by rec order by t rows between 2 preceding and 2 following) as near from frames"))
def w03(spark, sf):
    return W.dilate(frames(spark, sf).select("rec", "t", "voiced"), "rec", "t", "voiced", 2, "near", chunk=50).select("rec", "t", "near")


@query("w04_intervals", oracle(["frames"], """select rec, min(t) as start, max(t)+1 as "end" from (select rec, t, t - row_number() over (partition by rec order by t) as g from frames where voiced) group by rec, g having count(*)>=2"""))
def w04(spark, sf):
    return W.intervals(frames(spark, sf), "rec", "t", "voiced", 2, chunk=50)


ACT = """lv as (select rec, quantile_cont(level,0.10) as floor, quantile_cont(level,0.95) as speech, max(level) as mx from frames group by 1),
act as (select f.*, floor, speech, speech-floor as snr, case when speech-floor>3 then greatest(mx-2, floor+1) else mx-2 end as thr from frames f join lv using (rec)),
mask as (select *, level>thr as active from act)"""
KW = {"drop": 2.0, "gate": 3.0, "margin": 1.0}


@query("w05_activity_mask", oracle(["frames"], "select rec, round(max(floor),6) as floor, round(max(speech),6) as speech, round(max(thr),6) as thr, count(*) filter (active) as n_active from mask group by 1", ACT))
def w05(spark, sf):
    m = W.activity_mask(frames(spark, sf), "rec", "level", **KW)
    return m.groupBy("rec").agg(*[r6(F.max(c), c) for c in ("floor", "speech", "thr")], F.count_if("active").cast("long").alias("n_active"))


@query("w06_trim_bounds", oracle(["frames"], f"""select rec, count(*) as n, round(count(*) filter (active)/count(*)::double,6) as active_frac, round(min(t) filter (active)*{HOP},6) as lead, round((count(*)-1-max(t) filter (active))*{HOP},6) as trail,
 round(greatest(0, min(t) filter (active)*{HOP}-{MARGIN}),6) as trim_start, round(least((count(*)-1)*{HOP}+{WIN}, max(t) filter (active)*{HOP}+{WIN}+{MARGIN}),6) as trim_end from mask group by 1""".replace(str(HOP), "0.01::double").replace("0.025", "0.025::double"), ACT))
def w06(spark, sf):
    m = W.activity_mask(frames(spark, sf), "rec", "level", **KW)
    b = W.trim_bounds(m, "rec", "t", "active", HOP, WIN, MARGIN)
    return b.select("rec", "n", *[r6(c, c) for c in ("active_frac", "lead", "trail", "trim_start", "trim_end")])


@query("w07_background_masks", oracle(["frames"], """select rec, count(*) filter (ok) as n_ok, count(*) filter (active and ok) as n_active, count(*) filter (snr>3 and ok and not na and level<=floor+1.5) as n_a1, count(*) filter (snr>3 and ok and not nv) as n_a2 from
 (select *, bool_or(active) over w as na, bool_or(active and voiced) over w as nv from (select f.*, level>=-3 as ok, floor, speech-floor as snr, level>case when speech-floor>3 then greatest(mx-2,floor+1) else mx-2 end as active
   from frames f join (select rec, quantile_cont(level,0.10) as floor, quantile_cont(level,0.95) as speech, max(level) as mx from frames where level>=-3 group by 1) using (rec))
  window w as (partition by rec order by t rows between 2 preceding and 2 following)) group by 1"""))
def w07(spark, sf):
    m = W.background_masks(frames(spark, sf), "rec", "t", "level", "voiced", -3.0, 2, 1.5, 3.0, 2.0, 1.0, chunk=50)
    c = lambda x, n: F.count_if(x).cast("long").alias(n)
    return m.groupBy("rec").agg(c(F.col("ok"), "n_ok"), c(F.col("active") & F.col("ok"), "n_active"), c(F.col("A1"), "n_a1"), c(F.col("A2"), "n_a2"))


@query("w08_quiet_profile", oracle(["frames"], """select rec, pos, round(avg(x),6) as x, count(*) as n from (select f.rec, unnest([0,1,2]) as pos, unnest([level, value, case when voiced then 1.0::double else 0 end]) as x from frames f
 join (select rec, quantile_cont(level,0.1) as q from frames group by 1) using (rec) where level<=q) group by 1,2"""))
def w08(spark, sf):
    f = frames(spark, sf).withColumn("profile", F.array("level", "value", F.col("voiced").cast("double")))
    return W.quiet_profile(f, "rec", "level", "profile").select("rec", F.col("pos").cast("long").alias("pos"), r6("x", "x"), "n")


@query("w09_segments", oracle(["frames"], """select rec, n, s as start, least(n,40) as length from (select rec, n, unnest(case when n<=40 then [0] else list_distinct(list_concat(range(0, n-40+1, 20), [n-40])) end) as s from (select rec, count(*) as n from frames group by 1))"""))
def w09(spark, sf):
    n = frames(spark, sf).groupBy("rec").agg(N())
    return W.segments(n, "n", 40, 20)


@query("w10_frame_levels", oracle(["frames"], """select rec, frame, round(20*log10(sqrt(avg(value*value))+1e-12),6) as level_db from (select rec, value, unnest(range(greatest(0, cast(ceil((t-5+1)/2.0) as bigint)), least(case when n<5 then 0 else (n-5)//2 end, t//2)+1)) as frame
 from (select *, count(*) over (partition by rec) as n from frames)) group by 1,2"""))
def w10(spark, sf):
    return W.frame_levels(frames(spark, sf), "rec", "t", "value", 5, 2).select("rec", "frame", r6("level_db", "level_db"))


def curves(spark, sf):
    e = V.table(spark, sf, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("step")).agg(F.avg("value").alias("m"))
    return shared(e.select("event_type", "step", (F.col("m") / (F.col("m") + 10)).alias("x")))


CURVE = """curve as (select event_type, step, m/(m+10) as x from (select event_type, date_diff('day', date '2024-01-01', cast(ts as date)) as step, avg(value) as m from events group by 1,2)),
ma as (select event_type, step, round(avg(x) over (partition by event_type order by step range between 2 preceding and 2 following),12) as ma from curve)"""


@query("w11_moving_average", oracle([], "select event_type, step, round(ma,6) as ma from ma", CURVE))
def w11(spark, sf):
    return W.moving_average(curves(spark, sf), ["event_type"], "step", "x", 5, chunk=7).select("event_type", "step", r6("ma", "ma"))


@query("w12_one_se_step", oracle([], """select event_type, round(best,6) as best, best_step, round(thr,6) as thr, min(step) filter (ma>=thr) as step from (select *, best-sqrt((best*(1-best)+49*(best/(2-best)-best*best)+19*(2*best*best/(1+best)-best*best))/1000.0::double) as thr from
 (select ma.*, best, best_step from ma join (select event_type, max(ma) as best, arg_min(step, (-ma, step)) as best_step from ma group by 1) using (event_type))) group by 1,2,3,4""", CURVE))
def w12(spark, sf):
    s = W.one_se_step(curves(spark, sf), ["event_type"], "step", "x", 5, 50, 20)
    return s.select("event_type", r6("best", "best"), "best_step", r6("thr", "thr"), "step")


@query("w12_argmin_step", oracle([], "select event_type, arg_min(step, (ma, step)) as step, round(min(ma),6) as ma from ma group by 1", CURVE))
def w12b(spark, sf):
    return W.argmin_step(curves(spark, sf), ["event_type"], "step", "x", 5).withColumn("ma", r6("ma"))


@query("w13_level_stats", oracle(["frames"], """select rec, round(max(abs(value)),6) as peak, round(avg(cast(abs(value)>=100 as int)),6) as clip_frac, round(20*log10(sqrt(avg(value*value))+1e-12),6) as rms_db, round(quantile_cont(20*log10(abs(value)+1e-12),0.1),6) as floor,
 round(quantile_cont(20*log10(abs(value)+1e-12),0.95),6) as speech, round(quantile_cont(20*log10(abs(value)+1e-12),0.95)-quantile_cont(20*log10(abs(value)+1e-12),0.1),6) as snr, round(max(abs(value-level)),6) as channel_diff from frames group by 1"""))
def w13(spark, sf):
    s = W.level_stats(frames(spark, sf), "rec", "value", 100.0, "level")
    return s.select("rec", *[r6(c, c) for c in ("peak", "clip_frac", "rms_db", "floor", "speech", "snr", "channel_diff")])
