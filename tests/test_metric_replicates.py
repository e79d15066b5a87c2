"""Metric-space joins, array-valued replicates and the confound test on arrays against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.functions import hashing
from cohortry.operators import inference as I
from cohortry.operators import joins as J
from cohortry.operators import metricspace, replicates


def clustered(n, dims, groups, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (groups, dims))
    return centres[rng.integers(0, groups, n)] + rng.normal(0, spread, (n, dims))


def test_k_nearest_equals_brute_force(spark):
    x = clustered(700, 6, 12, 1).round(2)
    x[100:130] = x[100]  # many equal points
    by = np.where(np.arange(700) % 5 == 0, "small", "large")
    by[699] = "alone"
    df = spark.createDataFrame(pd.DataFrame({"unit": np.arange(700), "g": by, "v": x.tolist()}))
    got = metricspace.k_nearest(df, df, "unit", "v", 4, ["g"], rows=64, pivots=8).collect()
    found = {(r["unit"], r["rank"]): (r["nb"], r["d2"]) for r in got}
    assert len(found) == len(got)
    for i in range(700):
        others = [j for j in np.flatnonzero(by == by[i]) if j != i]
        want = sorted((round(float(((x[i] - x[j]) ** 2).sum()), 9), int(j)) for j in others)[:4]
        assert [found.get((i, k + 1)) for k in range(4)] == [(j, pytest.approx(d, abs=1e-8)) for d, j in want] + [None] * (4 - len(want))
    other = metricspace.k_nearest(df.filter("unit < 50"), df.filter("unit >= 650"), "unit", "v", 3, rows=16).groupBy("unit").count().collect()
    assert sorted(r["unit"] for r in other) == list(range(50)) and all(r["count"] == 3 for r in other)


def pairs_by_hand(x, entity):
    c = x - x.mean(axis=1, keepdims=True)
    u = c / np.linalg.norm(c, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    i, j = np.triu_indices(len(x), 1)
    keep = entity[i] != entity[j]
    return i[keep], j[keep], s[i, j][keep]


def test_similar_vectors_exact_with_few_products(spark):
    x = clustered(1500, 16, 25, 2)
    entity = np.arange(1500) % 40
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(1500), "e": entity, "v": x.tolist()}))
    i, j, s = pairs_by_hand(x, entity)
    report = {}
    top = [(r["a"], r["b"], r["corr"]) for r in J.near_duplicates(df, "id", "v", "e", 30, rows=100, report=report).collect()]
    best = np.lexsort((j, i, -s))[:30]
    assert [(a, b) for a, b, _ in top] == list(zip(i[best].tolist(), j[best].tolist(), strict=True)) and np.allclose([c for *_, c in top], s[best])
    assert report["all"] == 1500 * 1499 // 2 and report["products"] < report["all"] / 2
    row = J.similarity_summary(df, "id", "v", "e", 0.95, 0.99, rows=100, report=report).first()
    order = np.sort(s)
    want = order[int(np.ceil(0.99 * len(s))) - 1]
    assert (row["pairs"], row["flagged"]) == (len(s), int((s >= 0.95).sum())) and row["q_corr"] == pytest.approx(want, abs=1e-6) and row["q_bin"] == np.floor(row["q_corr"] * 1000) / 1000
    assert report["products"] < report["all"] / 2


def test_similar_vectors_small_and_empty(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0, 3.0]), (2, "a", [1.0, 2.0, 3.0]), (3, "b", [1.0, 2.0, 3.5]), (4, "b", [1.0, 1.0, 1.0])], "id long, e string, v array<double>")
    assert [(r["a"], r["b"], r["n_pairs"]) for r in J.near_duplicates(df, "id", "v", "e").collect()] == [(1, 3, 2)]
    assert J.similarity_summary(df, "id", "v", "e", 0.5).first()["pairs"] == 2
    none = df.limit(0)
    assert J.near_duplicates(none, "id", "v", "e").count() == 0 and J.similarity_summary(none, "id", "v", "e", 0.5).first()["pairs"] is None


def auc_by_hand(s, p, q):
    with np.errstate(invalid="ignore", divide="ignore"):
        return sum(p[i] * (q[s < s[i]].sum(axis=0) + 0.5 * q[s == s[i]].sum(axis=0)) for i in range(len(s))) / (p.sum(axis=0) * q.sum(axis=0))


def test_auc_arrays_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(replicates, "BLOCK", 7)
    rng = np.random.default_rng(3)
    n, draws = 260, 40
    s = np.where(rng.random(n) < 0.4, 0.5, rng.normal(size=n).round(1))  # one score holds a large share
    y = (rng.random(n) < 0.4).astype(int)
    arm = np.where(np.arange(n) % 3 == 0, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"unit": np.arange(n) // 2, "arm": arm, "s": s, "y": y})).withColumn("code", replicates.unit_code("unit", "x")).repartition(5)
    codes = {r["unit"]: r["code"] for r in df.collect()}
    w = hashing.poisson_np(np.array([codes[k // 2] for k in range(n)]), np.arange(draws))
    got = {(r["arm"], r["b"]): r["auc"] for r in replicates.auc_draws(df, "y", "s", "code", draws, ["arm"]).collect()}
    for a in "ab":
        k = arm == a
        want = auc_by_hand(s[k], np.where(y[k, None] == 1, w[k], 0), np.where(y[k, None] == 0, w[k], 0))
        assert np.allclose([got[a, b] for b in range(draws)], want)
    one = replicates.auc_draws(df.filter("y = 1"), "y", "s", "code", 5).collect()
    assert len(one) == 5 and all(r["auc"] is None for r in one)
    means = {(r["arm"], r["b"]): r["m"] for r in replicates.mean_draws(df, "s", "code", draws, ["arm"]).collect()}
    for a in "ab":
        k = arm == a
        assert np.allclose([means[a, b] for b in range(draws)], (s[k] @ w[k]) / w[k].sum(axis=0))


def test_permuted_labels_keep_the_number_of_cases(spark):
    rng = np.random.default_rng(4)
    n, draws = 331, 60
    s, y = rng.normal(size=n).round(1), (rng.random(n) < 0.3).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"unit": np.arange(n), "s": s, "y": y})).repartition(4)
    codes = np.array([r["c"] for r in df.orderBy("unit").select(replicates.unit_code("unit", "p").alias("c")).collect()])
    x = hashing.draws_np(codes, np.arange(draws))
    for rank in (1, int(y.sum()), n):
        limits = replicates.rank_limits(df.withColumn("c", replicates.unit_code("unit", "p")), "c", draws, rank)
        assert ((x <= limits[None, :]).sum(axis=0) == rank).all()
    case = (x.argsort(axis=0).argsort(axis=0) < y.sum()).astype(float)
    got = {r["b"]: r["auc"] for r in replicates.permuted_auc(df, "y", "s", "unit", draws, "p").collect()}
    assert np.allclose([got[b] for b in range(draws)], auc_by_hand(s, case, 1 - case))


@pytest.mark.parametrize("kind", ["partial", "full"])
def test_confound_test_equals_the_same_swaps_by_hand(spark, kind):
    rng = np.random.default_rng(5)
    n, draws, chunk = 61, 30, 8
    y = (rng.random(n) < 0.5).astype(float)
    c = 0.8 * y + rng.normal(size=n)
    s = 0.5 * c + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"unit": np.arange(n), "y": y, "c": c, "s": s})).repartition(3)
    got = I.confound_test(df, "c", "s", "y", "unit", draws, "t", kind, sweeps=2, chunk=chunk).iloc[0]
    slope, icpt = np.polyfit(y, c, 1)
    var = c.var() * (1 - np.corrcoef(c, y)[0, 1] ** 2)
    moved, other = (c, y) if kind == "partial" else (y, c)
    x = np.repeat(moved[:, None], draws, axis=1)

    def cost(m, o):
        return (m - icpt - slope * o) ** 2 if kind == "partial" else (o - icpt - slope * m) ** 2

    for sweep in range(2):
        h = [r["h"] for r in spark.range(n).select(hashing.h60("id", F.lit(f"t{sweep}")).alias("h")).collect()]
        order = np.lexsort((np.arange(n), h))
        coin = [r["h"] for r in spark.range(n // 2).select(hashing.h60("id", F.lit(f"t{sweep}acc")).alias("h")).collect()]
        for k in range(n // 2):
            i, j = order[2 * k], order[2 * k + 1]
            d = (cost(x[i], other[i]) + cost(x[j], other[j]) - cost(x[j], other[i]) - cost(x[i], other[j])) / (2 * var)
            u = (hashing.draws_np(np.array([coin[k]]), np.arange(draws))[0] >> np.uint64(11)) * 2.0**-53
            swap = u < 1 / (1 + np.exp(-d))
            x[i], x[j] = np.where(swap, x[j], x[i]), np.where(swap, x[i], x[j])
    obs = np.corrcoef(moved, s)[0, 1] ** 2
    hits = sum(np.corrcoef(x[:, b], s)[0, 1] ** 2 >= obs - 1e-12 for b in range(draws))
    assert got["p"] == pytest.approx((1 + hits) / (1 + draws)) and got["r2"] == pytest.approx(obs)


def test_confound_test_of_five_sweeps_by_hand_and_with_a_lone_unit(spark):
    """The values that meet in a row are those that swapping the whole table sweep by sweep gives; 3 units leave one without a partner."""
    draws = 40
    for n in (3, 90):
        rng = np.random.default_rng(n)
        y, s = np.arange(n) % 2.0, rng.normal(size=n)
        c = 0.5 * y + rng.normal(size=n)
        df = spark.createDataFrame(pd.DataFrame({"unit": np.arange(n), "y": y, "c": c, "s": s}))
        history = I._swap_history(df.select("unit", "s", F.col("c").alias("x"), F.col("y").alias("o")), 5, "t").toPandas()
        assert len(history) == (n + 1) // 2 and {len(v) for v in history["x"]} == {32} and {len(v) for v in history["coins"]} == {31}
        got = I.confound_test(df, "c", "s", "y", "unit", draws, "t", sweeps=5, chunk=16).iloc[0]
        slope = np.polyfit(y, c, 1)[0]
        var, x = c.var() * (1 - np.corrcoef(c, y)[0, 1] ** 2), np.repeat(c[:, None], draws, axis=1)
        for sweep in range(5):
            h = [r["h"] for r in spark.range(n).select(hashing.h60("id", F.lit(f"t{sweep}")).alias("h")).collect()]
            coin = [r["h"] for r in spark.range(n).select(hashing.h60("id", F.lit(f"t{sweep}acc")).alias("h")).collect()]
            order = np.lexsort((np.arange(n), h))
            for k in range(n // 2):
                i, j = order[2 * k], order[2 * k + 1]
                u = (hashing.draws_np(np.array([coin[k]]), np.arange(draws))[0] >> np.uint64(11)) * 2.0**-53
                swap = u < 1 / (1 + np.exp(-slope / var * (x[i] - x[j]) * (y[j] - y[i])))
                x[i], x[j] = np.where(swap, x[j], x[i]), np.where(swap, x[i], x[j])
        obs = np.corrcoef(c, s)[0, 1] ** 2
        assert got["p"] == pytest.approx((1 + sum(np.corrcoef(x[:, b], s)[0, 1] ** 2 >= obs - 1e-12 for b in range(draws))) / (1 + draws))


def test_permutations_by_place_are_uniform_and_give_the_same_products(spark, monkeypatch):
    keys = hashing.draws_np(np.array([3]), np.arange(24000))[0]
    for n in (1, 2, 3, 4):
        to = hashing.permuted_np(np.arange(n), n, keys)
        _, counts = np.unique(to, axis=1, return_counts=True)
        full = int(np.prod(np.arange(1, n + 1)))
        assert len(counts) == full and ((counts - 24000 / full) ** 2 / (24000 / full)).sum() < 60
    to = hashing.permuted_np(np.arange(1000), 1000, keys[:50])
    assert (np.sort(to, axis=0) == np.arange(1000)[:, None]).all() and abs(np.corrcoef(to[:, 0], to[:, 1])[0, 1]) < 0.15
    rng = np.random.default_rng(6)
    n, draws = 301, 40
    pdf = pd.DataFrame({"unit": np.arange(n), "y": (rng.random(n) < 0.3).astype(int), "r": rng.normal(size=n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    df = spark.createDataFrame(pdf).repartition(3)
    from cohortry.operators.resample import index_units

    place = index_units(df, "unit", ["y"]).toPandas()
    want = np.zeros((draws, 2))
    for y, some in place.merge(pdf, on=["unit", "y"]).sort_values("idx").groupby("y"):
        to = hashing.permuted_np(np.arange(len(some)), len(some), replicates.permutation_keys(str(y), draws, "p"))
        want += some["r"].to_numpy()[to].T @ some[["a", "b"]].to_numpy()
    assert np.allclose(replicates.permuted_products(df, ["a", "b"], "r", "unit", "y", draws, "p"), want)
    monkeypatch.setattr(replicates, "PIECE", 64)
    assert np.allclose(replicates.permuted_products(df, ["a", "b"], "r", "unit", "y", draws, "p"), want)
