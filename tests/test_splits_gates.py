"""Splits, leak checks, gates: invariants and planted faults."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.operators import clean as C
from cohortry.operators import frames as W
from cohortry.operators import gates as G
from cohortry.operators import joins as J
from cohortry.operators import splits as S


@pytest.fixture(scope="module")
def cohort(spark):
    r = np.random.default_rng(3)
    p = pd.DataFrame({"unit": range(300), "label": (r.random(300) < 0.7).astype(int), "day": r.integers(0, 40, 300)})
    p["grp"] = "d" + p.day.astype(str)
    p["strata"] = p.label.astype(str)
    return spark.createDataFrame(p).cache()


def bad(df):
    return {r["check"] for r in df.filter("n > 0").collect()}


def test_nested_splits_pass_and_leaks_fail(spark, cohort):
    s = S.nested_splits(cohort, "unit", "strata", 5, 2).cache()
    assert bad(S.check_splits(s, cohort, "unit", "label", 5)) == set()
    leak = s.withColumn("role", F.when((F.col("unit") == 7) & (F.col("outer_fold") == 0), "test").otherwise(F.col("role")))
    leak = leak.withColumn("role", F.when((F.col("unit") == 7) & (F.col("outer_fold") == 1), "test").otherwise(F.col("role")))
    assert "tested_once" in bad(S.check_splits(leak, cohort, "unit", "label", 5))
    assert "covers_cohort" in bad(S.check_splits(s.filter("unit <> 3"), cohort, "unit", "label", 5))
    again = S.nested_splits(cohort.repartition(11), "unit", "strata", 5, 2)
    assert S.changed_rows(s, again).isEmpty()


def test_grouped_splits_keep_groups_whole(spark, cohort):
    s = S.grouped_nested_splits(cohort, "unit", "grp", "label", 5, 0).cache()
    assert bad(S.check_splits(s, cohort, "unit", "label", 5, "grp")) == set()
    plain = S.nested_splits(cohort, "unit", "strata", 5, 1)
    assert "group_on_both_sides" in bad(S.check_splits(plain, cohort, "unit", "label", 5, "grp"))


def test_grouped_folds_deal_every_group_once(spark, cohort):
    f = S.grouped_folds(cohort, "grp", "label", 5, [1, 2])
    assert f.groupBy("seed").agg(F.count("*").alias("n"), F.countDistinct("grp").alias("g")).select("n", "g").distinct().collect() == [(40, 40)]
    n = cohort.join(f.filter("seed = 1"), "grp").groupBy("fold").agg(F.count("*").alias("n")).toPandas()
    assert n.n.sum() == 300 and len(n) == 5 and n.n.max() - n.n.min() <= 12
    assert S.grouped_folds(cohort.repartition(7), "grp", "label", 5, [1, 2]).exceptAll(f).isEmpty()


def test_stratum_merge_sizes(spark):
    rows = [(i, k) for k, n in (("1|early|young", 10), ("1|early|old", 5), ("1|late|old", 4), ("0|early|young", 6), ("0|late|old", 2)) for i in range(n)]
    plan = {r["key"]: r["merged_into"] for r in S.merge_plan(spark.createDataFrame(rows, "i int, key string"), "key", 5).collect()}
    assert plan == {"1|late|old": "1|early|young", "0|late|old": "0|early|young"}


def test_smote_stays_between_neighbours(spark):
    r = np.random.default_rng(1)
    p = pd.DataFrame({"unit": range(60), "label": [1] * 12 + [0] * 48, "cell": "a", "vec": [list(map(float, v)) for v in r.normal(size=(60, 3))]})
    one = pd.DataFrame({"unit": [100, 101, 102], "label": [1, 0, 0], "cell": "b", "vec": [[0.0] * 3] * 3})
    df = spark.createDataFrame(pd.concat([p, one]))
    s = S.smote(df, "unit", "vec", "label", ["cell"], "x").toPandas()
    assert len(s) == 36 and set(s.cell) == {"a"} and s.unit.between(0, 11).all() and s.nb.between(0, 11).all() and (s.unit != s.nb).all()
    X = np.stack(p.vec[:12])
    d = ((X[:, None] - X[None]) ** 2).sum(-1)
    for u, nb in zip(s.unit, s.nb):
        assert (d[u] < d[u, nb]).sum() <= 5


def test_intervals_cross_chunks(spark):
    flags = [False, True, True, True, True, False, True, False, True, True]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "rec int, t long, f boolean")
    for chunk in (2, 3, 100):
        got = sorted((r["start"], r["end"]) for r in W.intervals(df, "rec", "t", "f", 2, chunk).collect())
        assert got == [(1, 5), (8, 10)]
        near = [r["n"] for r in W.dilate(df, "rec", "t", "f", 1, "n", chunk).orderBy("t").collect()]
        assert near == [True] * 10


def test_id_scan_ignores_decimals(spark):
    t = spark.createDataFrame([(1, "id 123456 ok"), (2, "x 0.123456 y"), (3, "1234567"), (4, "654321.")], "k int, t string")
    ids = spark.createDataFrame([(123456,), (654321,)], "id long")
    assert [r["k"] for r in G.scan_id_leaks(t, ids, "t", "k", "id").collect()] == [1]


def test_publish_refuses_ids(spark, tmp_path):
    u = spark.createDataFrame([(123456, "a")], "unit long, s string")
    with pytest.raises(C.GuardError):
        G.publish(spark.createDataFrame([("a", 123456)], "s string, v long"), u, u, "unit", str(tmp_path / "p"), str(tmp_path / "q"))
    assert not (tmp_path / "q").exists()


def test_join_unique_drops_all_copies(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert {r["k"]: r["v"] for r in J.join_unique(left, right, ["k"], ["v"]).collect()} == {1: None, 2: "c"}


def test_decision_table_fail_safe(spark):
    base = dict(arm="x", p_holm=0.001, or_sd=2.0, boot_lo=1.3, p_cv3=0.01, k2_valid=True, e2h_or=1.5, or_df6=1.9, g1_positive=False, n5_p=None)
    rows = [base, {**base, "arm": "invalid", "k2_valid": False}, {**base, "arm": "weak", "p_cv3": 0.2}, {**base, "arm": "failed", "p_cv3": None}]
    schema = "arm string, p_holm double, or_sd double, boot_lo double, p_cv3 double, k2_valid boolean, e2h_or double, or_df6 double, g1_positive boolean, n5_p double"
    got = {r["arm"]: (r["status"], r["c3_cluster"], r["stage2_triggered"]) for r in G.decision_table(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"x": ("stage2_pending", True, True), "invalid": ("not_established", None, True), "weak": ("not_met", False, True), "failed": ("not_met", False, True)}


def test_similar_vectors_brute_force(spark):
    r = np.random.default_rng(5)
    X = r.normal(size=(90, 6))
    X[40] = X[3] + 0.01
    p = pd.DataFrame({"id": range(90), "e": np.arange(90) % 10, "v": [list(map(float, x)) for x in X]})
    df = spark.createDataFrame(p)
    found = J.similarity_summary(df, "id", "v", "e", 0.8, rows=16).first()
    Z = X - X.mean(1, keepdims=True)
    Z /= np.linalg.norm(Z, axis=1, keepdims=True)
    C_ = Z @ Z.T
    i, j = np.triu_indices(90, 1)
    keep = p.e.to_numpy()[i] != p.e.to_numpy()[j]
    assert found["flagged"] == int((C_[i, j][keep].round(6) >= 0.8).sum())
    assert found["pairs"] == int(keep.sum())
    top = J.near_duplicates(df, "id", "v", "e", rows=16).first()
    assert (top["a"], top["b"]) == (3, 40)


def test_small_stratum_without_partner_stops(spark):
    df = spark.createDataFrame([(i, "0|a|x") for i in range(8)] + [(100, "1|a|x")], "unit long, key string")
    with pytest.raises(Exception, match="no stratum to join for 1"):
        S.assign_strata(df, "key", 5).collect()
    with pytest.raises(Exception, match="no stratum for unit 7"):
        S.stratified_folds(spark.createDataFrame([(6, "a"), (7, None)], "unit long, s string"), "unit", "s", 2, 1).collect()


def test_digest_sums_pass_two_to_the_63(spark):
    from cohortry.functions.hashing import h60
    from cohortry.sources.tables import table_digest

    df = spark.range(200)
    want = sum(r[0] for r in df.select(h60(F.col("id").cast("string"))).collect())
    assert want > 2**63 and table_digest(df).first()["digest_a"] == str(want)


def test_fold_quotas_equal_the_loop_over_groups():
    import random

    from cohortry.operators.splits import fold_quotas

    rng = random.Random(4)
    for _ in range(30):
        k = rng.randint(2, 6)
        profiles = sorted({(rng.randint(0, 6), rng.randint(0, 6)): 0 for _ in range(rng.randint(1, 9))}, key=lambda p: (-sum(p), -p[0]))
        profiles = [(*p, rng.randint(1, 40)) for p in profiles]
        t0, t1 = (max(1, sum(p[i] * p[2] for p in profiles)) for i in (0, 1))
        held, want = [[0, 0] for _ in range(k)], []
        for n0, n1, c in profiles:
            got = [0] * k
            for i in range(c):
                f = min(range(k), key=lambda f: (held[f][0] * n0 * t1 * t1 + held[f][1] * n1 * t0 * t0, f)) if n0 + n1 else i % k
                got[f] += 1
                held[f][0] += n0
                held[f][1] += n1
            want.append(got)
        assert fold_quotas(profiles, k) == want
