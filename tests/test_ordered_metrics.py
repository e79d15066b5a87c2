"""Ordered primitives and metrics against brute force, on hand-made edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.operators import association as T
from cohortry.operators import metrics as M
from cohortry.operators import ordered as O
from cohortry.operators.resample import bootstrap_weights, permute_within


def brute_auc(y, s):
    p, n = s[y == 1], s[y == 0]
    if len(p) == 0 or len(n) == 0:
        return None
    return float(((p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :])).mean())


@pytest.fixture(scope="module")
def scored(spark):
    r = np.random.default_rng(0)
    p = pd.DataFrame({"unit": range(400), "g": r.integers(0, 3, 400), "y": r.integers(0, 2, 400), "s": r.integers(0, 40, 400) / 40.0})
    p.loc[p.g == 2, "y"] = 1  # one-class group
    return p


@pytest.mark.parametrize("parts,buckets", [(1, 2), (7, 16), (50, 64)])
def test_auc_any_partitioning(spark, scored, parts, buckets):
    df = spark.createDataFrame(scored).repartition(parts)
    got = {r["g"]: r["auc"] for r in M.auc(df, "y", "s", ["g"]).collect()}
    for g, d in scored.groupby("g"):
        want = brute_auc(d.y.to_numpy(), d.s.to_numpy())
        assert (got[g] is None) == (want is None)
        if want is not None:
            assert abs(got[g] - want) < 1e-12
    q = O.quantiles(df, "s", ["g"], {"a": 0.1, "b": 0.95}, buckets=buckets).toPandas().set_index("g")
    for g, d in scored.groupby("g"):
        assert abs(q.a[g] - np.percentile(d.s, 10)) < 1e-12 and abs(q.b[g] - np.percentile(d.s, 95)) < 1e-12


def test_ties_only_nan_and_null(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, float("nan")), (1, None)], "y int, s double")
    r = M.auc(df, "y", "s").first()
    assert (r["n1"], r["n0"], r["auc"]) == (2, 1, 0.5)


def test_stratified_auc_ignores_one_sided(spark, scored):
    df = spark.createDataFrame(scored)
    r = M.stratified_auc(df, "y", "s", ["g"]).first()
    wins = pairs = 0
    for _, d in scored.groupby("g"):
        a = brute_auc(d.y.to_numpy(), d.s.to_numpy())
        k = int(d.y.sum() * (1 - d.y).sum())
        wins, pairs = wins + (a or 0) * k, pairs + k
    assert r["pairs"] == pairs and abs(r["auc"] - wins / pairs) < 1e-12


def test_midrank_and_row_numbers(spark, scored):
    df = spark.createDataFrame(scored).repartition(9)
    got = O.midrank(df.select("unit", "g", "s"), "s", ["g"]).toPandas().set_index("unit")["rank"].sort_index()
    want = scored.groupby("g").s.rank()
    assert np.allclose(got.to_numpy(), want.to_numpy())
    rn = O.value_rank(df.select("unit", "g"), ["g"], "unit", []).toPandas().sort_values("unit")
    assert (rn.rn.to_numpy() == scored.groupby("g").cumcount().to_numpy() + 1).all()


def test_zero_variance_rules(spark):
    df = spark.createDataFrame([("z", 0.0), ("z", 0.0), ("p", 0.2), ("p", 0.2)], "k string, d double")
    t = {r["k"]: r["t"] for r in M.nadeau_bengio(df, "d", 0.25, ["k"]).collect()}
    assert t["z"] == 0.0 and t["p"] == float("inf")


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, k string, p double")
    got = {r["k"]: round(r["p_holm"], 6) for r in M.holm(df, "p", ["f"]).collect()}
    assert got == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_best_threshold_median_of_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.6), (1, 0.8)], "y int, p double")
    assert M.best_threshold(df, "y", "p").first()["threshold"] == 0.6


def test_bootstrap_counts_and_permutation(spark, scored):
    df = spark.createDataFrame(scored)
    w = bootstrap_weights(df, "unit", 7, "s").groupBy("b").agg(F.sum("w").alias("n")).collect()
    assert {r["n"] for r in w} == {400} and len(w) == 7
    p = permute_within(df, "unit", "y", ["g"], 3, "s").groupBy("g", "b").agg(F.sum("y").alias("k"), F.count("*").alias("n")).toPandas()
    want = scored.groupby("g").y.agg(["sum", "size"])
    for _, r in p.iterrows():
        assert r.k == want.loc[r.g, "sum"] and r.n == want.loc[r.g, "size"]


def test_tails():
    from cohortry.functions.numeric import chi2_sf_np, norm_sf_np, t_sf_np

    assert abs(norm_sf_np(1.959963984540054) - 0.025) < 1e-12
    assert abs(chi2_sf_np(3.841458820694124, 1.0) - 0.05) < 1e-10
    assert abs(chi2_sf_np(11.070497693516351, 5.0) - 0.05) < 1e-10
    assert abs(t_sf_np(2.2281388519649385, 10.0) - 0.025) < 1e-10


def test_fisher(spark):
    rows = [(1, 1)] * 8 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 5
    p = T.fisher_exact(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()["p"]
    assert abs(p - 0.03496503496503495) < 1e-9


def test_frames_keep_a_value_of_zero(spark, tmp_path):
    """ln(0) is minus infinity, as in SQL, not NULL: the frame counts in quantiles, quiet frames and differences."""
    import datetime

    values = [0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0]
    rows = [(1, datetime.datetime(2024, 1, 1, 0, i), i, "view", v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    from cohortry.operators import frames as W
    from cohortry.plans import views as V

    f = V.frames(spark, str(tmp_path))
    assert f.filter("t = 0").first()["level"] == float("-inf")
    low = W.quiet_profile(f.withColumn("p", F.array("level")), "rec", "level", "p", 0.0).collect()
    assert [(r["x"], r["n"]) for r in low] == [(float("-inf"), 1)]
    assert W.level_stats(f, "rec", "value", 100.0, "level").first()["channel_diff"] == float("inf")
