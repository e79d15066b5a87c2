"""Projections and derived columns (P rows). Guards return rows or one-row counts; `enforce` turns them into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import col
from ..functions.numeric import logit as logit_expr
from .ordered import attach_one


class GuardError(ValueError):
    """A data guard found violations."""


def enforce(violations: DataFrame, what: str, count: str | None = None) -> None:
    """Raise if a violations frame has rows (or its count column is not zero). Reads a few rows only."""
    bad = violations if count is None else violations.filter(F.col(count) != 0)
    rows = bad.limit(5).collect()
    if rows:
        raise GuardError(f"{what}: {rows}")


def parse_decimal_comma(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P1. Locale numbers to double; unparseable text becomes NULL here and is reported by the guard below."""
    return df.withColumns({c: F.expr(f"try_cast(replace(trim(`{c}`), ',', '.') as double)") for c in cols})


def parse_guard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P1 guard: non-NULL cells that do not parse, per column (one aggregate over the table)."""
    parsed = [F.expr(f"count_if(`{c}` is not null and try_cast(replace(trim(`{c}`), ',', '.') as double) is null)").alias(c) for c in cols]
    return df.agg(*parsed).unpivot([], [*cols], "column", "n_bad")


def recode(df: DataFrame, c: str, mapping: dict[str, str], out: str) -> DataFrame:
    """P2. Closed-map recode (the map is a short literal)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.try_element_at(m, F.col(c)))


def recode_guard(df: DataFrame, c: str, out: str) -> DataFrame:
    return df.agg(F.count(c).alias("n_raw"), F.count(out).alias("n_mapped"), (F.count(c) - F.count(out)).alias("n_lost"))


def add_phase(df: DataFrame, date: str, label: str, out: str = "phase") -> DataFrame:
    """P3. early / late around the last control date; NULL dates are `unknown` before any comparison."""
    t = attach_one(df, df.agg(F.max(F.when(F.col(label) == 0, F.col(date))).alias("_last")))
    phase = F.when(F.col(date).isNull(), "unknown").when(F.col(date) <= F.col("_last"), "early").otherwise("late")
    return t.withColumn(out, phase).drop("_last")


def cut(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """P4. Right-closed bins (lo, hi]; outside or NULL -> NULL."""
    out = None
    for lo, hi, name in zip(edges, edges[1:], labels):
        cond = (col(c) > lo) & (col(c) <= hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def half_day(hour) -> Column:
    return F.when(col(hour).isNull(), "unknown").when(col(hour) < 12.0, "AM").otherwise("PM")


def add_context_cell(df: DataFrame, phase: str, hour: str, out: str = "cell") -> DataFrame:
    """P5. phase x AM/PM."""
    return df.withColumn(out, F.concat_ws("-", F.col(phase), half_day(hour)))


def add_overlap_flag(df: DataFrame, date: str, label: str, out: str = "overlap") -> DataFrame:
    """P6. Date inside the controls' own date range (inclusive); NULL dates are outside."""
    ctrl = F.when(F.col(label) == 0, F.col(date))
    t = attach_one(df, df.agg(F.min(ctrl).alias("_lo"), F.max(ctrl).alias("_hi")))
    return t.withColumn(out, F.coalesce(F.col(date).between(F.col("_lo"), F.col("_hi")), F.lit(False))).drop("_lo", "_hi")


def parse_bool_text(c) -> Column:
    """P6. Booleans serialised as text, any case."""
    t = F.lower(F.trim(col(c).cast("string")))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def split_right(df: DataFrame, c: str, left: str, right: str, sep: str = "_") -> DataFrame:
    """P7. Split at the last separator."""
    pat = f"^(.*){sep}([^{sep}]*)$"
    return df.withColumns({left: F.nullif(F.regexp_extract(c, pat, 1), F.lit("")), right: F.nullif(F.regexp_extract(c, pat, 2), F.lit(""))})


def parse_names(df: DataFrame, path: str) -> DataFrame:
    """P8. <entity>_<slot>.<ext> from the base name, plus a flag when a directory carries another 6-digit id."""
    base = F.element_at(F.split(F.col(path), "/"), -1)
    pat = r"^(\d{6})_(\d)\.[A-Za-z0-9]+$"
    ent = F.nullif(F.regexp_extract(base, pat, 1), F.lit(""))
    dirs = F.regexp_extract_all(F.regexp_replace(F.col(path), r"[^/]*$", ""), F.lit(r"(?<!\d)(\d{6})(?!\d)"), F.lit(1))
    out = df.withColumns({"entity": ent, "slot": F.nullif(F.regexp_extract(base, pat, 2), F.lit("")).cast("int")})
    return out.withColumn("id_conflict", F.coalesce(F.size(F.array_except(dirs, F.array(ent))) > 0, F.lit(False)))


def localize(df: DataFrame, ts: str, zone: str) -> DataFrame:
    """P9. UTC timestamp text -> local timestamp, date and fractional hour; failures stay visible in `ts_error`."""
    t = F.expr(f"try_cast(`{ts}` as timestamp_ntz)")
    out = df.withColumn("local_ts", F.convert_timezone(F.lit("UTC"), F.lit(zone), t))
    return out.withColumns({
        "local_date": F.to_date("local_ts"),
        "local_hour": F.hour("local_ts") + F.minute("local_ts") / F.lit(60.0),
        "ts_error": F.when(F.col(ts).isNotNull() & t.isNull(), F.lit("unparseable")),
    })


def classify_prefix(c, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """P10. First matching prefix wins; NULL and unmatched take the default."""
    out = F.lit(default)
    for prefix, name in reversed(rules):
        out = F.when(F.startswith(col(c), F.lit(prefix)), name).otherwise(out)
    return out


def coalesce_with_source(df: DataFrame, a: str, b: str, out: str, names: tuple[str, str] = ("file", "csv")) -> DataFrame:
    """P11. Preferred value, fallback, and which one was used."""
    return df.withColumns({
        out: F.coalesce(F.col(a), F.col(b)),
        f"{out}_source": F.when(F.col(a).isNotNull(), names[0]).when(F.col(b).isNotNull(), names[1]).otherwise("none"),
    })


def whole_years(end, start) -> Column:
    """P12. Completed years as floor(days / 365.2425)."""
    return F.floor(F.datediff(col(end), col(start)) / F.lit(365.2425)).cast("long")


def add_day_index(df: DataFrame, date: str, out: str = "days") -> DataFrame:
    """P12. Days since the first date of the table."""
    t = attach_one(df, df.agg(F.min(date).alias("_d0")))
    return t.withColumn(out, F.datediff(F.col(date), F.col("_d0")).cast("long")).drop("_d0")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("rate")
    )


def zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), suffix: str = "_z") -> DataFrame:
    """P13. Population z-score; zero spread only centres. Group statistics are joined back (no whole-group window)."""
    st = df.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    t = df.join(st, list(by)) if by else attach_one(df, st)
    z = {f"{c}{suffix}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in cols}
    return t.withColumns(z).drop(*st.columns[len(by):])


def clipped_logit(c, eps: float = 1e-6) -> Column:
    """P13. ln(p/(1-p)) with p clipped to [eps, 1-eps]."""
    return logit_expr(c, eps)


ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿğışİĞŞ", "aaaaaaceeeeiiiinooooouuuuyygisIGS")


def fold_accents(c) -> Column:
    """Lower-case letters only, accents folded."""
    t = F.lower(F.translate(F.lower(col(c)), *ACCENTS))
    return F.regexp_replace(F.translate(t, *ACCENTS), "[^a-z]", "")


def recognise_slot(df: DataFrame, c: str, rules: Sequence[tuple[str, int]], out: str = "slot") -> DataFrame:
    """P14. Accent-folded name -> slot by prefix rules; no rule -> NULL (reported by `unrecognised`)."""
    key = fold_accents(c)
    slot = F.lit(None).cast("int")
    for prefix, n in reversed(rules):
        slot = F.when(F.startswith(key, F.lit(prefix)), n).otherwise(slot)
    return df.withColumn(out, slot)


def unrecognised(df: DataFrame, c: str, slot: str = "slot") -> DataFrame:
    return df.filter(F.col(slot).isNull()).groupBy(c).agg(F.count(F.lit(1)).cast("long").alias("n"))


def fill_profile(df: DataFrame, label: str, cols: Sequence[str], filled: float = 0.8) -> DataFrame:
    """P15. Fill rate of every column in both groups and its class: both / cases_only / controls_only / partial."""
    aggs = []
    for c in cols:
        has = F.col(c).isNotNull().cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.avg(F.when(F.col(label) == 1, has)).alias("fill_1"),
                             F.avg(F.when(F.col(label) == 0, has)).alias("fill_0")))
    t = df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
    kind = F.when((F.col("fill_1") >= filled) & (F.col("fill_0") >= filled), "both").when(
        (F.col("fill_0") == 0) & (F.col("fill_1") > 0), "cases_only").when(
        (F.col("fill_1") == 0) & (F.col("fill_0") > 0), "controls_only").otherwise("partial")
    return t.withColumn("kind", kind)


def melt_slots(df: DataFrame, ids: Sequence[str], cols: Sequence[str], value: str = "value") -> DataFrame:
    """P16. Wide repeated measures -> (id, slot, value); slot is the number in the column name."""
    long = df.unpivot(list(ids), list(cols), "_name", value)
    return long.withColumn("slot", F.regexp_extract("_name", r"(\d+)", 1).cast("long")).drop("_name")


def retry_counts(long: DataFrame, entity: str, value: str) -> DataFrame:
    return long.groupBy(entity).agg(F.count_if(F.col(value) > 0).cast("long").alias("n_slots_retried"), F.sum(value).cast("long").alias("n_retries"))
