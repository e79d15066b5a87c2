"""Resampling without rows per replicate: every statistic carries an array with one entry per draw.

The Poisson weight of a unit in draw b is a function of (code of the unit, b), made where the row is (`poisson_np`), so B draws cost B numbers while a row is in hand and nothing
per row that is stored or shuffled. What leaves a task is a few arrays of length B per group and slice of the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draws_np, h60, permuted_np, poisson_np
from .ordered import BUCKET, value_buckets
from .resample import index_units

#: Rows whose weights are held at once: rows x draws numbers.
BLOCK = 512


def unit_code(unit: str, seed: str):
    """Code of a unit for `poisson_np`: units with one code share their draws (arms of one unit, rows of one cluster)."""
    return h60(unit, F.lit(seed))


def _runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Stretches of rows with equal keys of a sorted partition, at most BLOCK rows each."""
    for frame in frames:
        if not len(frame):
            continue
        new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        new[0] = True
        starts = np.flatnonzero(new).tolist()
        for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
            for k in range(a, b, BLOCK):
                some = frame.iloc[k:min(b, k + BLOCK)]
                yield tuple(some[keys].iloc[0].tolist()), some


def poisson_sides(codes: np.ndarray, case: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (rows x draws) of the rows as cases and as controls: Poisson counts of the unit."""
    w = poisson_np(codes, draws)
    return np.where(case[:, None], w, 0.0), np.where(case[:, None], 0.0, w)


def permuted_sides(limits: np.ndarray) -> Callable:
    """Labels permuted in every draw: the units whose numbers are at most the draw's limit are the cases."""
    def sides(codes: np.ndarray, case: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (draws_np(codes, draws) <= limits[None, :]).astype(float)
        return w, 1 - w

    return sides


def rank_limits(df: DataFrame, code: str, draws: int, rank: int, digit: int = 8) -> np.ndarray:
    """Per draw, the rank-th smallest of the units' 64-bit numbers, exactly: counts by leading digit, pass by pass, until the digits are known. A pass sends draws x 256 counts
    per task and keeps no number."""
    numbers, base = np.arange(draws), 1 << digit
    prefix, left = np.zeros(draws, dtype=np.uint64), np.full(draws, rank, dtype=np.int64)
    codes = df.select(F.col(code).alias("_code"))
    for k in range(64 // digit):
        shift = np.uint64(64 - digit * (k + 1))

        def counted(frames: Iterator[pd.DataFrame], prefix: np.ndarray = prefix, shift: np.uint64 = shift, k: int = k) -> Iterator[pd.DataFrame]:
            total = np.zeros(draws * base, dtype=np.int64)
            for frame in frames:
                for at in range(0, len(frame), BLOCK):
                    x = draws_np(frame["_code"].to_numpy()[at:at + BLOCK], numbers)
                    top = x >> shift
                    here = (top >> np.uint64(digit)) == prefix[None, :] if k else np.ones(x.shape, dtype=bool)
                    slot = numbers[None, :] * base + (top & np.uint64(base - 1)).astype(np.int64)
                    total += np.bincount(slot[here], minlength=draws * base)
            used = np.flatnonzero(total)
            yield pd.DataFrame({"at": used, "n": total[used]})

        each = codes.mapInPandas(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros(draws * base, dtype=np.int64)
        table[each["at"].to_numpy()] = each["n"].to_numpy()
        cum = table.reshape(draws, base).cumsum(axis=1)
        found = (cum < left[:, None]).sum(axis=1)
        left = left - np.where(found > 0, cum[numbers, np.maximum(found - 1, 0)], 0)
        prefix = (prefix << np.uint64(digit)) | found.astype(np.uint64)
        alone = table.reshape(draws, base)[numbers, found] == 1
        if alone.all() and k < 64 // digit - 1:
            # one number of each draw has this prefix: nothing else lies between its beginning and the end of its range
            rest = np.uint64(64 - digit * (k + 1))
            return (prefix << rest) | ((np.uint64(1) << rest) - np.uint64(1))
    return prefix


def permuted_auc(df: DataFrame, y: str, s: str, unit: str, draws: int, seed: str) -> DataFrame:
    """AUC of s for labels permuted over the units: (b, auc). Each draw has exactly as many cases as the data: the units with the smallest numbers of the draw."""
    t = df.filter(F.col(y).isin(0, 1) & F.col(s).isNotNull()).withColumn("_unit_code", unit_code(unit, seed))
    cases = t.agg(F.sum(F.col(y).cast("long"))).first()[0] or 0
    if not cases:
        return auc_draws(t, y, s, "_unit_code", draws)
    return auc_draws(t, y, s, "_unit_code", draws, sides=permuted_sides(rank_limits(t, "_unit_code", draws, cases)))


def auc_draws(df: DataFrame, y: str, s: str, code: str, draws: int, by: Sequence[str] = (), sides: Callable = poisson_sides) -> DataFrame:
    """AUC in every draw: (by, b, auc), ties one half; NULL where a draw has one class only. `sides` gives the weights of rows as cases and controls.

    Scores are cut into ordered slices. A slice is read in score order with running weight arrays and gives, per draw, its case weight, control weight and the wins inside it
    (rows of a slice are dealt to one task; a score that fills a slice is dealt to several, which add up). Slices are put together per group from (slices x draws) numbers.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    names = [*keys, BUCKET]
    t = df.filter(F.col(y).isin(0, 1) & F.col(s).isNotNull())
    for k in by:
        t = t.filter(F.col(k).isNotNull())
    kinds = dict(df.dtypes)
    t = t.select(*[F.col(k).alias(n) for k, n in zip(by, keys, strict=True)], F.col(y).cast("int").alias("_y"), F.col(s).cast("double").alias("_s"), F.col(code).alias("_code"))
    t = value_buckets(t, "_s")
    # a slice of one score only has no order inside: its rows can be dealt to many tasks
    edge = t.groupBy(BUCKET).agg((F.min("_s") == F.max("_s")).alias("_flat"))
    width = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    t = t.join(F.broadcast(edge), BUCKET).withColumn("_salt", F.when(F.col("_flat"), F.pmod(F.col("_code"), F.lit(width))).otherwise(0).cast("int"))
    cols = [*names, "_salt"]
    numbers = np.arange(draws)
    key_schema = ", ".join([f"{n} {kinds[k]}" for n, k in zip(keys, by, strict=True)] + [f"{BUCKET} int"])

    def sliced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def closed():
            p, q, wins, tie_p, tie_q, _ = state
            wins = wins + tie_p * (q + 0.5 * tie_q)
            return pd.DataFrame([(*now[:-1], (p + tie_p).tolist(), (q + tie_q).tolist(), wins.tolist())], columns=[*names, "p", "q", "wins"])

        for at, some in _runs(frames, cols):
            if at != now:
                if now is not None:
                    yield closed()
                now, state = at, [*(np.zeros(draws) for _ in range(5)), None]
            score = some["_s"].to_numpy()
            change = np.flatnonzero(np.concatenate(([True], score[1:] != score[:-1])))
            pos, neg = (np.add.reduceat(w, change) for w in sides(some["_code"].to_numpy(), some["_y"].to_numpy() == 1, numbers))
            p, q, wins, tie_p, tie_q, last = state
            for k, value in enumerate(score[change].tolist()):
                if value != last:
                    wins, p, q = wins + tie_p * (q + 0.5 * tie_q), p + tie_p, q + tie_q
                    tie_p, tie_q, last = pos[k], neg[k], value
                else:
                    tie_p, tie_q = tie_p + pos[k], tie_q + neg[k]
            state = [p, q, wins, tie_p, tie_q, last]
        if now is not None:
            yield closed()

    arrays = "p array<double>, q array<double>, wins array<double>"
    parts = t.repartition(width, *cols).sortWithinPartitions(*cols, "_s").mapInPandas(sliced, f"{key_schema}, {arrays}")
    parts = parts.join(F.broadcast(edge), BUCKET)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        p = q = wins = np.zeros(draws)
        for _, slice_ in pdf.sort_values(BUCKET, kind="stable").groupby(BUCKET, sort=True):
            here_p, here_q = np.sum(np.stack(slice_["p"].to_numpy()), axis=0), np.sum(np.stack(slice_["q"].to_numpy()), axis=0)
            inside = 0.5 * here_p * here_q if slice_["_flat"].iloc[0] else np.sum(np.stack(slice_["wins"].to_numpy()), axis=0)
            wins = wins + inside + here_p * q
            p, q = p + here_p, q + here_q
        with np.errstate(invalid="ignore", divide="ignore"):
            auc = wins / (p * q)
        out = pd.DataFrame({"b": numbers, "auc": pd.array(np.where(p * q > 0, auc, np.nan), dtype="Float64")})
        for n in keys:
            out[n] = pdf[n].iloc[0]
        return out[[*keys, "b", "auc"]]

    if not keys:
        parts = parts.withColumn("_one", F.lit(0))
    grouped = parts.groupBy(*(keys or ["_one"])).applyInPandas(joined, ", ".join([f"{n} {kinds[k]}" for n, k in zip(keys, by, strict=True)] + ["b long, auc double"]))
    return grouped.select(*[F.col(n).alias(k) for n, k in zip(keys, by, strict=True)], "b", F.when(~F.isnan("auc"), F.col("auc")).alias("auc"))


def mean_draws(df: DataFrame, x: str, code: str, draws: int, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of x in every Poisson draw: (by, b, m); NULL where no row is drawn. Tasks send two arrays of sums per group."""
    keys = [f"_k{i}" for i in range(len(by))]
    kinds = dict(df.dtypes)
    t = df.filter(F.col(x).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(by, keys, strict=True)], F.col(x).cast("double").alias("_x"), F.col(code).alias("_code"))
    numbers = np.arange(draws)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}
        for frame in frames:
            for at, some in (frame.groupby(keys, dropna=False) if keys else [((), frame)]):
                both = held.setdefault(at if isinstance(at, tuple) else (at,), [np.zeros(draws), np.zeros(draws)])
                for k in range(0, len(some), BLOCK):
                    w = poisson_np(some["_code"].to_numpy()[k:k + BLOCK], numbers)
                    both[0] += some["_x"].to_numpy()[k:k + BLOCK] @ w
                    both[1] += w.sum(axis=0)
            if len(held) > 64:
                yield packed(held)
                held = {}
        yield packed(held)

    def packed(held: dict) -> pd.DataFrame:
        out = pd.DataFrame([(*at, a.tolist(), b.tolist()) for at, (a, b) in held.items()], columns=[*keys, "sx", "sw"])
        return out

    schema = ", ".join([f"{n} {kinds[k]}" for n, k in zip(keys, by, strict=True)] + ["sx array<double>, sw array<double>"])
    parts = t.mapInPandas(sums, schema)
    each = parts.select(*keys, F.posexplode(F.arrays_zip("sx", "sw")).alias("b", "z"))
    return each.groupBy(*keys, "b").agg(F.sum("z.sx").alias("sx"), F.sum("z.sw").alias("sw")).select(
        *[F.col(n).alias(k) for n, k in zip(keys, by, strict=True)], F.col("b").cast("long").alias("b"), F.when(F.col("sw") > 0, F.col("sx") / F.col("sw")).alias("m"))


#: Places whose values meet a block of rows at once, and rows of such a block.
PIECE, ROWS = 1 << 20, 1 << 16


def permutation_keys(stratum: str, draws: int, seed: str) -> np.ndarray:
    """One 64-bit key per draw for the permutations of a stratum."""
    start = int.from_bytes(hashlib.md5(f"{seed}|{stratum}".encode()).digest()[:7], "big")
    return draws_np(np.array([start]), np.arange(draws))[0]


def permuted_products(df: DataFrame, cols: Sequence[str], r: str, unit: str, by: str, draws: int, seed: str) -> np.ndarray:
    """draws x cols sums of cols x r with r permuted inside every stratum `by`, one permutation of the units per draw.

    Units have places in hash order. A block of rows works out where its places go in each draw and looks the values up in r, which lies in pieces of at most PIECE places; a block
    meets every piece and sends draws x cols sums. Nothing is stored per unit and draw. Beyond PIECE units of a stratum the places are worked out once per piece.
    """
    spark = df.sparkSession
    t = df.select(unit, F.col(by).cast("string").alias("_by"), F.col(r).cast("double").alias("_r"), F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))
    t = t.join(index_units(t, unit, ["_by"]).select(unit, "idx", "n"), unit).select("_by", "idx", "n", "_r", "_x")
    blocks = F.greatest(F.lit(2 * spark.sparkContext.defaultParallelism), F.ceil(F.col("n") / ROWS)).cast("long")
    last = F.floor((F.col("n") - 1) / PIECE).cast("long")
    piece = F.floor(F.col("idx") / PIECE).cast("long")
    values = t.groupBy("_by", piece.alias("piece"), blocks.alias("blocks")).agg(F.array_sort(F.collect_list(F.struct("idx", "_r")))["_r"].alias("values"))  # at most PIECE
    values = values.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = t.withColumn("block", F.col("idx") % blocks).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    k = len(cols)

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"sums": []})
        n, first = int(left["n"].iloc[0]), int(left["piece"].iloc[0]) * PIECE
        value, x, at = np.asarray(right["values"].iloc[0], float), np.stack(left["_x"].to_numpy()), left["idx"].to_numpy()
        keys, sums = permutation_keys(left["_by"].iloc[0], draws, seed), np.zeros((draws, k))
        for i in range(0, len(at), BLOCK):
            for b in range(0, draws, BLOCK):
                to = permuted_np(at[i:i + BLOCK], n, keys[b:b + BLOCK]) - first
                here = np.where((to >= 0) & (to < len(value)), value[np.clip(to, 0, len(value) - 1)], 0.0)
                sums[b:b + BLOCK] += here.T @ x[i:i + BLOCK]
        return pd.DataFrame({"sums": [sums.ravel()]})

    keys = ["_by", "piece", "block"]
    width = 4 * spark.sparkContext.defaultParallelism
    theirs = [f"_to{k}" for k in keys]
    values = values.select(*[F.col(k).alias(to) for k, to in zip(keys, theirs, strict=True)], "values")
    parts = rows.repartition(width, *keys).groupBy(*keys).cogroup(values.repartition(width, *theirs).groupBy(*theirs)).applyInPandas(met, "sums array<double>")
    each = parts.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # draws x cols numbers
    out = np.zeros(draws * k)
    out[each["at"].to_numpy()] = each["v"].to_numpy()
    return out.reshape(draws, k)


def draws_sql(code: str, b: str, source: str, keep: str) -> str:
    """DuckDB: a query with `keep` of `source` and x, the 64-bit number of (code, b) of `draws_np`."""
    mod = "18446744073709551616::uhugeint"

    def times(x: str, c: int) -> str:
        return f"(({x})::uhugeint * {c}::uhugeint % {mod})::ubigint"

    q = f"select {keep}, ((({code})::uhugeint + ((({b}) + 1)::uhugeint * {0x9E3779B97F4A7C15}::uhugeint) % {mod}) % {mod})::ubigint as x from {source}"
    for _ in range(2):
        q = f"select {keep}, {times('xor(x, x >> 30)', 0xBF58476D1CE4E5B9)} as x from ({q})"
        q = f"select {keep}, {times('xor(x, x >> 27)', 0x94D049BB133111EB)} as x from ({q})"
        q = f"select {keep}, xor(x, x >> 31) as x from ({q})"
    return q


def poisson_sql(code: str, b: str, source: str, keep: str) -> str:
    """DuckDB: the same with w, the Poisson(1) count of `poisson_np`."""
    from ..functions.hashing import POISSON_CDF

    u = "(x >> 11)::double * 1.1102230246251565e-16::double"
    return f"select {keep}, " + " + ".join(f"({u} >= {float(c)!r}::double)::bigint" for c in POISSON_CDF) + f" as w from ({draws_sql(code, b, source, keep)})"
