"""Join operators (J rows): grid completion, unique attach, guards, table comparison, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import n_if
from ..session import shared
from .metricspace import Cells, cells
from .ordered import attach_one


def complete_grid(entities: DataFrame, facts: DataFrame, entity: str, slot: str, slots: Sequence[int]) -> DataFrame:
    """J1. Every entity x slot with the number of facts and OK / MISSING / MULTIPLE.

    Entities and facts meet in one aggregate with a count per slot, before the slots become rows: nothing is joined, and what follows by entity needs no further shuffle.
    """
    key, at = F.col(entity), F.col(slot)
    kinds = dict(facts.dtypes)
    rows = entities.select(key, F.lit(None).cast(kinds[slot]).alias("_slot"), F.lit(1).alias("_own")).unionByName(
        facts.filter(key.isNotNull() & at.isin([int(s) for s in slots])).select(key, at.alias("_slot"), F.lit(0).alias("_own")))
    per = rows.groupBy(entity).agg(F.sum("_own").alias("_own"), *[F.count_if(F.col("_slot") == int(s)).alias(f"_n{i}") for i, s in enumerate(slots)]).filter("_own > 0")
    per = per.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_own"))))  # an entity given twice stays twice
    cells = F.array(*[F.struct(F.lit(int(s)).cast("long").alias(slot), F.col(f"_n{i}").alias("n")) for i, s in enumerate(slots)])
    out = per.select(key.cast(dict(entities.dtypes)[entity]).alias(entity), F.inline(cells))
    return out.withColumn("status", F.when(F.col("n") == 0, "MISSING").when(F.col("n") == 1, "OK").otherwise("MULTIPLE"))


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """J2. Attach attributes only where the key is unique on the right; every copy of a repeated key is dropped."""
    once = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(a).alias(a) for a in attrs]).filter("_n = 1").drop("_n")
    return left.join(once, list(keys), "left")


def restrict(df: DataFrame, cohort: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J3. Semi join."""
    return df.join(cohort.select(*keys), list(keys), "left_semi")


def unmatched(df: DataFrame, ref: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J3. Anti join."""
    return df.join(ref.select(*keys), list(keys), "left_anti")


def key_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J4. Symmetric difference of two key sets with the side each key is on. Empty = equal sets."""
    sides = a.select(*keys, F.lit(1).alias("_s")).unionByName(b.select(*keys, F.lit(2).alias("_s")))
    g = sides.groupBy(*keys).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).filter(F.col("_lo") == F.col("_hi"))
    return g.select(*keys, F.when(F.col("_lo") == 1, "left_only").otherwise("right_only").alias("side"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n")).filter("n > 1")


def join_checked(a: DataFrame, b: DataFrame, keys: Sequence[str], validate: str = "many_to_one", how: str = "left") -> tuple[DataFrame, DataFrame]:
    """J5. Join plus the violations of the stated cardinality (rows: side, key, n). Empty violations = row count preserved."""
    viol = duplicate_keys(b, keys).withColumn("side", F.lit("right"))
    if validate == "one_to_one":
        viol = viol.unionByName(duplicate_keys(a, keys).withColumn("side", F.lit("left")))
    return a.join(b, list(keys), how), viol


def attach(df: DataFrame, dim: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """J6. Attribute lookup by key. The optimizer broadcasts the dimension when its measured size allows, otherwise it shuffles."""
    return df.join(dim, key if isinstance(key, str) else list(key), "left")


def missing_attr(df: DataFrame, attr: str) -> DataFrame:
    return df.agg(F.count_if(F.col(attr).isNull()).cast("long").alias("n_missing"), F.count(F.lit(1)).cast("long").alias("n"))


def _cells(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    return df.select(key, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([key], list(cols), "column", "value")


def table_diff(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """J7. Null-safe cell differences per column, with rows found on one side only."""
    j = a.select(key, F.struct(*cols).alias("_a")).join(b.select(key, F.struct(*cols).alias("_b")), key, "full")
    only_a, only_b = F.col("_b").isNull(), F.col("_a").isNull()
    diffs = [F.count_if(~only_a & ~only_b & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).cast("long").alias(c) for c in cols]
    return j.agg(n_if(only_a).alias("rows_left_only"), n_if(only_b).alias("rows_right_only"), F.count(F.lit(1)).cast("long").alias("rows"), *diffs).unpivot(
        ["rows_left_only", "rows_right_only", "rows"], list(cols), "column", "n_diff"
    )


def field_agreement(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str], tol: float = 0.0) -> DataFrame:
    """J8. Share of equal cells per field (within tol for numbers) and the chance level sum(p^2) of the left table."""
    kind = dict(a.dtypes)
    j = a.select(key, F.struct(*cols).alias("_a")).join(b.select(key, F.struct(*cols).alias("_b")), key)
    pairs = []
    for c in cols:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        same = (F.abs(x - y) <= tol) if kind[c] != "string" else (x == y)
        pairs.append(F.struct(F.lit(c).alias("field"), same.cast("double").alias("same")))
    agree = j.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.field").agg(F.count("p.same").cast("long").alias("n"), F.avg("p.same").alias("agreement"))
    counts = _cells(a, key, cols).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).cast("double").alias("k"))
    chance = counts.groupBy(F.col("column").alias("field")).agg((F.sum(F.col("k") * F.col("k")) / (F.sum("k") * F.sum("k"))).alias("chance"))
    return agree.join(chance, "field")


def ownership_trace(a: DataFrame, b: DataFrame, key: str, label: str, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """J9. A measurement combination found on id X in b: does it belong to X in a, to another id, or to nobody?

    Owners are reduced to (count, own match) without listing them: per combination the number of owners and of owner
    labels, and a second keyed join for the row's own id. A combination shared by very many ids stays one row.
    """
    k = F.concat_ws("|", *[F.coalesce(F.round(c, digits).cast("string") if t == "double" else F.col(c).cast("string"), F.lit("~")) for c, t in
                           [(c, dict(a.dtypes)[c]) for c in cols]])
    left = a.select(F.col(key).alias("_id"), F.col(label).cast("string").alias("_lab"), k.alias("_k"))
    owners = left.groupBy("_k").agg(F.min("_lab").alias("_l0"), F.max("_lab").alias("_l1"))
    right = b.select(F.col(key).alias("_id"), F.col(label).cast("string").alias("row_label"), k.alias("_k"))
    t = right.join(owners, "_k", "left").join(left.select("_id", "_k", F.lit(True).alias("_own")), ["_id", "_k"], "left")
    outcome = F.when(F.col("_own"), "own").when(F.col("_l0").isNotNull(), "other").otherwise("nobody")
    owner = F.when(F.col("_own"), F.col("row_label")).when(F.col("_l0") == F.col("_l1"), F.col("_l0")).when(F.col("_l0").isNotNull(), "mixed").otherwise("none")
    return t.groupBy(outcome.alias("outcome"), owner.alias("owner_label"), "row_label").agg(F.count(F.lit(1)).cast("long").alias("n"))


def apply_selection(preds: DataFrame, selection: DataFrame, arm: str = "arm", keys: Sequence[str] = ("repeat", "fold")) -> DataFrame:
    """J10. Keep, per fold, the predictions of the arm chosen for that fold."""
    return preds.join(selection.select(*keys, F.col("selected").alias(arm)), [*keys, arm], "left_semi")


def selection_unique(selection: DataFrame, keys: Sequence[str] = ("repeat", "fold")) -> DataFrame:
    return duplicate_keys(selection, keys)


def delta_vs_baseline(df: DataFrame, keys: Sequence[str], variant: str, baseline, value: str) -> DataFrame:
    """J11. Difference to the baseline variant of the same keys (keys without a baseline get NULL)."""
    base = df.filter(F.col(variant) == baseline).groupBy(*keys).agg(F.max(value).alias("baseline"))
    return df.join(base, list(keys), "left").withColumn("delta", F.col(value) - F.col("baseline"))


def exact_duplicates(df: DataFrame, digest: str, entity: str) -> DataFrame:
    """J13. Groups of identical content: size and number of distinct entities (two-level, so a huge group pre-aggregates)."""
    per = df.groupBy(digest, entity).agg(F.count(F.lit(1)).alias("_n"))
    g = per.groupBy(digest).agg(F.sum("_n").cast("long").alias("n"), F.count(F.lit(1)).cast("long").alias("n_entities"), F.max("_n").cast("long").alias("max_in_entity"))
    return g.filter("n > 1").withColumn("across_entities", F.col("n_entities") > 1).withColumn("within_entity", F.col("max_in_entity") > 1)


def identity_collisions(df: DataFrame, date: str, other: str, entity: str, label: str) -> DataFrame:
    """J14. Groups sharing (date, attribute): size, label counts, first / last id and the placeholder-date flag.

    Member ids stay rows (`identity_members`); no group is gathered into one list.
    """
    g = df.filter(F.col(date).isNotNull() & F.col(other).isNotNull()).groupBy(date, other).agg(
        F.count(F.lit(1)).cast("long").alias("n"), n_if(F.col(label) == 1).alias("n1"), n_if(F.col(label) == 0).alias("n0"),
        F.min(entity).alias("first_id"), F.max(entity).alias("last_id"),
    )
    return g.filter("n > 1").withColumn("placeholder", (F.month(date) == 1) & (F.dayofmonth(date) == 1))


def identity_members(df: DataFrame, date: str, other: str, entity: str, label: str) -> DataFrame:
    g = identity_collisions(df, date, other, entity, label).select(date, other)
    return df.select(entity, label, date, other).join(g, [date, other], "left_semi")


def exclusion_closure(df: DataFrame, donors: DataFrame, entity: str, group: str) -> DataFrame:
    """J15. Donors and everyone who shares a donor's group (NULL group = only the donor)."""
    d = df.join(donors.select(entity), entity, "left_semi")
    groups = d.select(group).filter(F.col(group).isNotNull()).distinct()
    same = df.join(groups, group, "left_semi").select(entity)
    return same.unionByName(d.select(entity)).distinct()


def closure_guard(df: DataFrame, excluded: DataFrame, entity: str, label: str) -> DataFrame:
    """J15 guard: what is left for training, share kept, both labels present."""
    left = df.join(excluded.select(entity), entity, "left_anti")
    kept = left.agg(F.count(F.lit(1)).cast("long").alias("n_left"), n_if(F.col(label) == 1).alias("n1"), n_if(F.col(label) == 0).alias("n0"))
    out = attach_one(kept, df.agg(F.count(F.lit(1)).cast("long").alias("n_all")))
    return out.withColumn("ok", (F.col("n_left") * 2 >= F.col("n_all")) & (F.col("n1") > 0) & (F.col("n0") > 0))


# --- J12 / M26: similar vectors ------------------------------------------------------------------------------------

def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def standardise_rows(df: DataFrame, vec: str, out: str = "u", digits: int | None = None) -> DataFrame:
    """Row-standardised unit vectors: the dot product of two of them is their Pearson correlation."""
    x = F.transform(vec, lambda v: v.cast("double"))
    mean = F.aggregate("_x", F.lit(0.0), lambda s, v: s + v) / F.size("_x")
    norm = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda s, v: s + v * v))
    t = df.withColumn("_x", x).withColumn("_m", mean).withColumn("_c", F.transform("_x", lambda v: v - F.col("_m"))).withColumn("_n", norm)
    return t.filter("_n > 0").withColumn(out, F.transform("_c", lambda v: v / F.col("_n"))).drop("_x", "_m", "_c", "_n")


def _similarity_cells(df: DataFrame, key: str, vec: str, entity: str, rows: int) -> Cells:
    """Unit vectors in cells of a metric space. Copies of one vector inside one entity collapse to a single weighted row first."""
    u = standardise_rows(df.select(key, vec, entity), vec)
    u = u.groupBy(F.md5(F.to_json(F.struct(vec))).alias("_d"), F.col(entity).alias("e")).agg(F.min(key).alias("id"), F.count(F.lit(1)).cast("long").alias("n"), F.first("u").alias("u"))
    return cells(shared(u.drop("_d")), "id", "u", rows)


def _cross_pairs(left, right, keep, least: float = -2.0):
    """(a, b, weight, rounded correlation) of the product's pairs of different entities, a < b; those whose rounded correlation is below `least` may be left out."""
    import numpy as np

    sim = left["u"] @ right["u"].T
    hit = sim >= least - 1e-6
    if keep is not None:
        hit &= keep
    i, j = np.divmod(np.flatnonzero(hit), hit.shape[1])
    other = left["e"][i] != right["e"][j]
    i, j = i[other], j[other]
    a, b = left["id"][i], right["id"][j]
    return np.minimum(a, b), np.maximum(a, b), left["n"][i] * right["n"][j], np.round(sim[i, j], 6)


def _correlation_bounds(space: Cells):
    """(least, largest) possible correlation between members of two cells: |u - v|^2 = 2 - 2 corr for unit vectors."""
    low, high = space.bounds()
    return 1 - high * high / 2 - 1e-6, 1 - low * low / 2 + 1e-6


def _noted(report: dict | None, space: Cells, pairs) -> None:
    if report is not None:
        n = int(space.size.sum())
        report.update(products=space.products(pairs), all=n * (n - 1) // 2)


def near_duplicates(df: DataFrame, key: str, vec: str, entity: str, k: int = 50, rows: int = 2048, report: dict | None = None) -> DataFrame:
    """J12. The k most similar cross-entity pairs (the report's size) of row-standardised vectors: a, b, n_pairs, corr; ties broken by ids. Exact.

    Pairs inside cells come first; the k-th best correlation found there excludes every pair of cells whose bound is below it, and what a product makes below it. A task
    keeps its k best pairs from product to product. `report` gets the number of vector products made and that of all pairs.
    """
    import numpy as np
    import pandas as pd

    space = _similarity_cells(df, key, vec, entity, rows)

    def top(pairs, floor: float) -> DataFrame:
        def tile(parts) -> pd.DataFrame:
            held, least = [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0)], floor
            for left, right, keep in parts:
                new = _cross_pairs(left, right, keep, least)
                if len(new[3]) > k:
                    high = new[3] >= np.partition(new[3], -k)[-k]
                    new = [x[high] for x in new]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)]
                best = np.lexsort((held[1], held[0], -held[3]))[:k]
                held = [x[best] for x in held]
                least = max(least, held[3][-1]) if len(best) == k else least
            return pd.DataFrame(dict(zip(("a", "b", "n_pairs", "corr"), held, strict=True)))

        return space.tiles(pairs, tile, "a long, b long, n_pairs long, corr double", "id").orderBy(F.desc("corr"), "a", "b").limit(k)

    own = np.eye(len(space.size), dtype=bool)
    found = shared(top(own, -2.0))
    kth = found.agg(F.count("*").alias("n"), F.min("corr").alias("c")).first()
    bound = kth["c"] if kth["n"] == k else -2.0
    more = (_correlation_bounds(space)[1] >= bound) & ~own
    _noted(report, space, own | more)
    return found.union(top(more, bound)).orderBy(F.desc("corr"), "a", "b").limit(k)


def _sampled_quantile(points: DataFrame, q: float, n: int = 2048, margin: float = 1.5, width: int = 8) -> tuple[int, tuple[int, int]]:
    """From the pairs of a bounded sample of rows: a bin of 0.001 that is likely below the q-quantile of the correlation, and the range of bins that likely holds it."""
    import numpy as np

    from ..functions.hashing import h60

    rows = points.select(h60("id", F.lit("guess")).alias("h"), "id", "e", "n", "u").orderBy("h", "id").limit(n).collect()
    if len(rows) < 2:
        return -1001, (0, 0)
    side = {c: np.array([r[c] for r in rows]) for c in ("id", "e", "n", "u")}
    *_, w, s = _cross_pairs(side, side, np.triu(np.ones((len(rows),) * 2, dtype=bool), 1))
    if not len(s):
        return -1001, (0, 0)
    order = np.argsort(s)
    share = np.cumsum(w[order]) / w.sum()
    below, at = (int(np.floor(s[order][min(np.searchsorted(share, p), len(s) - 1)] * 1000)) for p in (max(0.0, 1 - margin * (1 - q)), q))
    return below - 1, (at - width, at + width + 1)


def similarity_summary(df: DataFrame, key: str, vec: str, entity: str, thr: float, q: float = 0.99, rows: int = 2048, report: dict | None = None) -> DataFrame:
    """J12. All cross-entity pairs (`pairs`), those of correlation >= thr (`flagged`), and the exact q-quantile of the correlation (`q_corr`: the smallest value, at six digits,
    with at least a share q of the pairs at or below it) with the 0.001-wide bin that holds it (`q_bin`).

    The number of pairs needs no comparison. A bounded sample of rows says where the quantile lies: what is clearly below it and `thr` is neither compared (cells) nor counted
    (pairs), and values near it are counted with the bins. The counts prove the guess: where too few pairs lie above it, all pairs are counted, and where the bin lies outside
    the counted values, a second pass over what reaches that bin counts them (at most 1,000).
    """
    import math
    from fractions import Fraction

    import numpy as np
    import pandas as pd

    space = _similarity_cells(df, key, vec, entity, rows)
    spark = df.sparkSession
    sums = space.points.groupBy("e").agg(F.sum("n").alias("n")).agg(F.sum("n").cast("decimal(38,0)").alias("t"), F.sum(F.col("n").cast("decimal(19,0)") * F.col("n")).alias("s")).first()
    total = (int(sums["t"] or 0) ** 2 - int(sums["s"] or 0)) // 2
    low, high = _correlation_bounds(space)
    rank = total - math.ceil(Fraction(str(q)) * total) + 1
    guess, near = _sampled_quantile(space.points, q)

    def gathered(pairs, least: int, values: tuple[int, int]) -> tuple[int, dict[int, int], dict[float, int]]:
        """Pairs of at least `thr`, pairs by bin (from `least` up), pairs by value in the bins from values[0] to below values[1]."""
        first, span = values[0] * 1000 - 1000, max(0, values[1] - values[0]) * 1000 + 2000

        def counted(parts) -> pd.DataFrame:
            flags, bins, exact = 0, np.zeros(2003), np.zeros(span)
            for left, right, keep in parts:
                *_, w, s = _cross_pairs(left, right, keep, min(thr, least / 1000))
                flags += int(w[s >= thr].sum())
                at = np.floor(s * 1000).astype(np.int64)
                bins += np.bincount(at[at >= least] + 1001, weights=w[at >= least], minlength=2003)
                fine = (at >= values[0]) & (at < values[1])
                exact += np.bincount(np.rint(s[fine] * 1e6).astype(np.int64) - first, weights=w[fine], minlength=span)
            rows_of = [(0, np.zeros(1, dtype=np.int64), np.array([flags]))]
            rows_of += [(kind, np.flatnonzero(c) + start, c[c > 0]) for kind, c, start in ((1, bins, -1001), (2, exact, first))]
            return pd.concat([pd.DataFrame({"kind": kind, "at": at, "n": n.astype(np.int64)}) for kind, at, n in rows_of])

        parts = space.tiles(pairs, counted, "kind int, at long, n long", "id").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()  # bins and some thousand values
        got = [{r["at"]: r["n"] for r in parts if r["kind"] == kind} for kind in range(3)]
        return got[0].get(0, 0), got[1], {v / 1e6: n for v, n in got[2].items()}

    def bin_of(counts: dict[int, int]) -> tuple[int | None, int]:
        """Bin that holds the rank-th largest pair, and the number of pairs above it."""
        above = 0
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= rank:
                return b, above
            above += counts[b]
        return None, above

    everything = np.ones((len(space.size),) * 2, dtype=bool)
    compared = high >= min(thr, guess / 1000)
    flagged, counts, values = gathered(compared, guess, near)
    at, above = bin_of(counts) if total else (None, 0)
    if total and at is None:  # the sample misled: the quantile lies below
        compared = everything
        _, counts, values = gathered(compared, -1001, near)
        at, above = bin_of(counts)
    _noted(report, space, compared)
    value = None
    if at is not None:
        if not near[0] <= at < near[1]:
            _, _, values = gathered((low <= (at + 1) / 1000) & (high >= at / 1000), at, (at, at + 1))
        for v in sorted((v for v in values if math.floor(v * 1000) == at), reverse=True):
            above += values[v]
            if above >= rank:
                value = v
                break
    row = (total or None, None if at is None else at / 1000.0, value, flagged)
    return spark.createDataFrame([row], "pairs long, q_bin double, q_corr double, flagged long")


def entity_similarity(df: DataFrame, key: str, vec: str, entity: str, slot: str, digits: int = 4, rows: int = 2048) -> DataFrame:
    """M26. Do two recordings of one entity (different slots) look more alike than recordings of two entities?

    Dimensions are z-scored over the table and rows scaled to length one; every cross-slot pair is compared in a dense product,
    a task returns counts per rounded similarity, so the AUC comes from at most 2 x 20,001 weighted rows.
    """
    import numpy as np
    import pandas as pd

    from .metrics import auc

    long = df.select(key, entity, slot, F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    st = long.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = st.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s")))).scalar()  # one entry per dimension
    z = F.zip_with("_x", "_st", lambda x, t: (x - t["m"]) / F.when(t["s"] > 0, t["s"]).otherwise(1.0))
    t = df.select(key, entity, slot, F.transform(vec, lambda v: v.cast("double")).alias("_x")).withColumn("_st", stats).withColumn("_z", z)
    t = t.withColumn("_n", F.sqrt(F.aggregate("_z", F.lit(0.0), lambda s, v: s + v * v))).filter("_n > 0")
    t = shared(t.select(F.col(key).alias("id"), F.col(entity).alias("e"), F.col(slot).alias("g"), F.transform("_z", lambda v: v / F.col("_n")).alias("u")))
    scale = 10**digits

    def tile(parts) -> pd.DataFrame:
        counts = np.zeros((2, 2 * scale + 3), dtype=np.int64)  # by same entity, rounded similarity
        for left, right, keep in parts:
            at = np.rint((left["u"] @ right["u"].T) * scale).astype(np.int32) + (scale + 1)
            at += (left["e"][:, None] == right["e"][None, :]) * np.int32(counts.shape[1])
            ok = left["g"][:, None] != right["g"][None, :]
            counts += np.bincount(at[ok if keep is None else ok & keep], minlength=counts.size).reshape(counts.shape)
        same, sim = np.nonzero(counts)
        return pd.DataFrame({"same": same, "sim": (sim - scale - 1) / scale, "n": counts[same, sim]})

    n = t.count()
    whole = Cells(t.withColumn("_cell", F.lit(0)), np.zeros((1, 1)), np.zeros(1), np.array([n]), rows)  # every pair counts, so cells would exclude none
    parts = shared(whole.tiles(np.array([[n > 0]]), tile, "same int, sim double, n long", "id").groupBy("same", "sim").agg(F.sum("n").cast("long").alias("n")))
    a = auc(parts, "same", "sim", (), "n").withColumnsRenamed({"n1": "pairs_same", "n0": "pairs_other"})
    m = parts.agg((F.sum(F.when(F.col("same") == 1, F.col("sim") * F.col("n"))) / F.sum(F.when(F.col("same") == 1, F.col("n")))).alias("mean_same"),
                  (F.sum(F.when(F.col("same") == 0, F.col("sim") * F.col("n"))) / F.sum(F.when(F.col("same") == 0, F.col("n")))).alias("mean_other"))
    return attach_one(a, m)
