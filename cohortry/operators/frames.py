"""Ordered frame analytics (W rows). Long series are cut into chunks with a halo, so no series needs one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import n_if
from .metrics import hanley_mcneil
from .ordered import BUCKET, bucketed_prefix, frame_window, quantiles

CHUNK = 100_000


def informative_strata(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """W2. Keep strata that hold both labels and add the stratum mean (stratum table joined back; no whole-stratum window)."""
    st = df.groupBy(*keys).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.avg(label).alias("cell_mean")).filter("_lo <> _hi")
    return df.join(st.drop("_lo", "_hi"), list(keys))


def dilate(df: DataFrame, rec: str, t: str, flag: str, g: int, out: str, chunk: int = CHUNK) -> DataFrame:
    """W3. TRUE where any frame within +-g frames is TRUE."""
    return frame_window(df, [rec], t, g, g, {out: lambda w: F.max(F.col(flag)).over(w)}, chunk)


def intervals(df: DataFrame, rec: str, t: str, flag: str, min_len: int = 1, chunk: int = CHUNK) -> DataFrame:
    """W4. Runs of consecutive TRUE frames as [start, end) with a minimum length.

    A run starts where the previous frame is not TRUE; its number is the running count of starts, so a run that crosses
    chunk borders keeps one number.
    """
    prev = {"_prev": lambda w: F.max(F.when(F.col(flag), F.col(t))).over(w.rangeBetween(-1, -1))}
    s = frame_window(df.select(rec, t, flag), [rec], t, 1, 0, prev, chunk).filter(F.col(flag))
    start = F.col("_prev").isNull().cast("long")
    s = s.withColumn("_s", start).withColumn(BUCKET, F.floor(F.col(t) / F.lit(chunk)).cast("long"))
    s = bucketed_prefix(s, [rec], [t], {"_before": F.col("_s")}).withColumn("_run", F.col("_before") + F.col("_s"))
    g = s.groupBy(rec, "_run").agg(F.min(t).alias("start"), (F.max(t) + 1).alias("end"))
    return g.filter(F.col("end") - F.col("start") >= min_len).select(rec, "start", "end")


def activity_levels(df: DataFrame, rec: str, level: str, drop: float = 35.0, gate: float = 20.0, margin: float = 10.0) -> DataFrame:
    """W5. Per recording: floor p10, speech p95, SNR proxy and the activity threshold
    (max - drop, raised to floor + margin when speech - floor > gate)."""
    q = quantiles(df, level, [rec], {"floor": 0.10, "speech": 0.95}).join(df.groupBy(rec).agg(F.max(level).alias("_mx")), rec)
    snr = F.col("speech") - F.col("floor")
    thr = F.col("_mx") - drop
    return q.withColumn("snr", snr).withColumn("thr", F.when(snr > gate, F.greatest(thr, F.col("floor") + margin)).otherwise(thr)).drop("_mx", "n")


def activity_mask(df: DataFrame, rec: str, level: str, **kw) -> DataFrame:
    return df.join(activity_levels(df, rec, level, **kw), rec).withColumn("active", F.col(level) > F.col("thr"))


def trim_bounds(frames: DataFrame, rec: str, t: str, active: str, hop: float, win: float, margin: float) -> DataFrame:
    """W6. Leading / trailing inactivity, active share and trim bounds clamped to the recording."""
    g = frames.groupBy(rec).agg(F.count(F.lit(1)).cast("long").alias("n"), n_if(F.col(active)).alias("n_active"),
                                F.min(F.when(F.col(active), F.col(t))).alias("_a"), F.max(F.when(F.col(active), F.col(t))).alias("_b"))
    dur = (F.col("n") - 1) * hop + win
    return g.select(
        rec, "n", (F.col("n_active") / F.col("n")).alias("active_frac"), (F.col("_a") * hop).alias("lead"), ((F.col("n") - 1 - F.col("_b")) * hop).alias("trail"),
        F.greatest(F.lit(0.0), F.col("_a") * hop - margin).alias("trim_start"), F.least(dur, F.col("_b") * hop + win + margin).alias("trim_end"),
    )


def background_masks(df: DataFrame, rec: str, t: str, level: str, voiced: str, silence: float, guard: int, room_margin: float, gate: float,
                     drop: float, margin: float, chunk: int = CHUNK) -> DataFrame:
    """W7. A1 = ok, away from every active frame, near the floor; A2 = ok, away from voiced frames; both empty at low SNR.

    Floor, speech level and threshold come from the ok frames (level >= silence).
    """
    ok = df.withColumn("ok", F.col(level) >= silence)
    lev = activity_levels(ok.filter("ok"), rec, level, drop=drop, gate=gate, margin=margin)
    f = ok.join(lev, rec).withColumn("active", F.col(level) > F.col("thr")).withColumn("_v", F.col("active") & F.col(voiced))
    near = {"_na": lambda w: F.max("active").over(w), "_nv": lambda w: F.max("_v").over(w)}
    f = frame_window(f, [rec], t, guard, guard, near, chunk)
    valid = F.col("snr") > gate
    return f.withColumns({"A1": valid & F.col("ok") & ~F.col("_na") & (F.col(level) <= F.col("floor") + room_margin), "A2": valid & F.col("ok") & ~F.col("_nv")}).drop("_na", "_nv", "_v")


def quiet_profile(df: DataFrame, rec: str, energy: str, vec: str, q: float = 0.10) -> DataFrame:
    """W8. Mean profile of the quietest frames of each recording: (rec, pos, x)."""
    thr = quantiles(df, energy, [rec], {"_q": q}).drop("n")
    quiet = df.join(thr, rec).filter(F.col(energy) <= F.col("_q"))
    return quiet.select(rec, F.posexplode(vec).alias("pos", "x")).groupBy(rec, "pos").agg(F.avg("x").alias("x"), F.count(F.lit(1)).cast("long").alias("n"))


def segments(df: DataFrame, n: str, win: int, hop: int) -> DataFrame:
    """W9. Window starts every hop, the last one end-aligned; a series no longer than the window is one piece."""
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), F.col(n) - win, F.lit(hop).cast("long")), F.array(F.col(n) - win)))
    t = df.withColumn("start", F.explode(F.when(F.col(n) <= win, F.array(F.lit(0).cast("long"))).otherwise(starts)))
    return t.withColumn("length", F.least(F.col(n), F.lit(win).cast("long")))


def frame_levels(df: DataFrame, rec: str, t: str, x: str, win: int, hop: int) -> DataFrame:
    """W10. RMS level in dB of overlapping frames; a series shorter than the window is one frame.

    Each sample is sent to the at most ceil(win / hop) frames that cover it and pre-aggregated before the shuffle.
    """
    n = df.groupBy(rec).agg((F.max(t) + 1).alias("_n"))
    s = df.join(n, rec)
    last = F.when(F.col("_n") < win, F.lit(0)).otherwise(F.floor((F.col("_n") - win) / F.lit(hop))).cast("long")
    lo = F.greatest(F.lit(0), F.ceil((F.col(t) - win + 1) / F.lit(hop))).cast("long")
    hi = F.least(last, F.floor(F.col(t) / F.lit(hop)).cast("long"))
    s = s.withColumn("frame", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    g = s.groupBy(rec, "frame").agg(F.avg(F.col(x) * F.col(x)).alias("_ms"))
    return g.select(rec, "frame", (20 * F.log10(F.sqrt("_ms") + 1e-12)).alias("level_db"))


def moving_average(df: DataFrame, by: Sequence[str], t: str, x: str, k: int, out: str = "ma", chunk: int = CHUNK) -> DataFrame:
    """W11. Centred moving average, truncated at the edges."""
    h = k // 2
    return frame_window(df, by, t, h, h, {out: lambda w: F.avg(x).over(w)}, chunk)


def one_se_step(curve: DataFrame, by: Sequence[str], t: str, x: str, k: int, n1: int, n0: int) -> DataFrame:
    """W12. First step whose smoothed AUC reaches the best smoothed AUC minus one standard error."""
    ma = moving_average(curve, by, t, x, k).withColumn("ma", F.round("ma", 12))
    top = ma.groupBy(*by).agg(F.max("ma").alias("best"), F.min_by(t, F.struct(-F.col("ma"), F.col(t))).alias("best_step"))
    top = top.withColumn("thr", F.col("best") - hanley_mcneil("best", F.lit(n1), F.lit(n0)))
    return ma.join(top, list(by)).groupBy(*by, "best", "best_step", "thr").agg(F.min(F.when(F.col("ma") >= F.col("thr"), F.col(t))).alias("step"))


def argmin_step(curve: DataFrame, by: Sequence[str], t: str, x: str, k: int) -> DataFrame:
    """W12, loss curve: step with the smallest smoothed value, earliest on ties."""
    ma = moving_average(curve, by, t, x, k).withColumn("ma", F.round("ma", 12))
    return ma.groupBy(*by).agg(F.min_by(t, F.struct("ma", t)).alias("step"), F.min("ma").alias("ma"))


def level_stats(df: DataFrame, rec: str, x: str, clip: float, other: str | None = None) -> DataFrame:
    """W13. Peak, clipped share, RMS dB, p10 / p95 of the level in dB, SNR proxy, largest channel difference."""
    lev = df.withColumn("_db", 20 * F.log10(F.abs(x) + 1e-12))
    q = quantiles(lev, "_db", [rec], {"floor": 0.10, "speech": 0.95})
    diff = F.max(F.abs(F.col(x) - F.col(other))) if other else F.lit(0.0)
    st = df.groupBy(rec).agg(F.max(F.abs(x)).alias("peak"), F.avg((F.abs(x) >= clip).cast("double")).alias("clip_frac"),
                             (20 * F.log10(F.sqrt(F.avg(F.col(x) * F.col(x))) + 1e-12)).alias("rms_db"), diff.alias("channel_diff"))
    return q.join(st, rec).withColumn("snr", F.col("speech") - F.col("floor"))
