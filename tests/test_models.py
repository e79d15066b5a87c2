"""Batched Newton, penalised and conditional fits against their definitions, and planted-truth probes."""

from unittest import mock

import numpy as np
import pandas as pd
import pytest

from cohortry.functions import hashing
from cohortry.operators import inference as I
from cohortry.operators.glm import Spec, design, fit_many
from cohortry.plans import q_models

def log_e(eta, m):
    """Log of the elementary symmetric polynomial of exp(eta), by recursion over the rows."""
    e = np.full(m + 1, -np.inf)
    e[0] = 0.0
    for v in eta:
        e[1:] = np.logaddexp(e[1:], e[:-1] + v)
    return e[m]


@pytest.mark.parametrize("apart", [False, True])
def test_penalised_conditional_fit_in_pieces_is_a_maximum(spark, apart):
    """Small strata cut into pieces of four rows. The penalised conditional likelihood is computed here by recursion, its information by differences; where a column
    separates the labels inside every stratum, only the penalty keeps the fit finite."""
    k = np.arange(96)
    t = pd.DataFrame({"g": k % 8, "a": np.sin(1.7 * k).round(3), "b": (k * k % 23 / 11.0 - 1).round(3), "id": k})
    t["y"] = ((k * 37 % 101) / 101 < 0.35 + 0.3 * (t["a"] > 0)).astype(int)
    if apart:
        t["a"] = np.where(t["y"] == 1, 2.0, -2.0) + 0.2 * t["a"]
    parts = [(d[["a", "b"]].to_numpy(), d["y"].to_numpy()) for _, d in t.groupby("g")]
    parts = [(X, y) for X, y in parts if 0 < y.sum() < len(y)]

    def plain(v):
        return sum(y @ X @ v - log_e(X @ v, int(y.sum())) for X, y in parts)

    def value(v, h=1e-3):
        e = h * np.eye(2)
        info = [[-(plain(v + e[i] + e[j]) - plain(v + e[i] - e[j]) - plain(v - e[i] + e[j]) + plain(v - e[i] - e[j])) / (4 * h * h) for j in range(2)] for i in range(2)]
        return plain(v) + 0.5 * np.linalg.slogdet(np.array(info))[1]

    f = I.fit_clogit(spark.createDataFrame(t), ["a", "b"], "y", "g", piece=4)
    assert f.converged and abs(f.ll - value(f.coef)) < 1e-3
    r = np.random.default_rng(31)
    assert all(value(f.coef + r.normal(0, 0.1, 2)) < f.ll + 1e-4 for _ in range(40))


def test_penalised_fit_without_a_column_is_the_restricted_maximum(spark):
    k = np.arange(140)
    X = np.column_stack([np.ones(140), np.cos(2.3 * k), (k % 9 - 4) / 3.0])
    y = ((k * 53 % 139) / 139 < 0.4 + 0.25 * np.cos(2.3 * k)).astype(float)

    def value(v):
        p = 1 / (1 + np.exp(-X @ v))
        return (y * (X @ v) - np.logaddexp(0, X @ v)).sum() + 0.5 * np.linalg.slogdet((X.T * (p * (1 - p))) @ X)[1]

    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": X[:, 1], "b": X[:, 2]}))
    fits = fit_many(design(df, [], ["a", "b"], "y"), [Spec("full"), Spec("less", fixed=1)], firth=True)
    full, less = fits[("all", "full")], fits[("all", "less")]
    assert full.converged and abs(full.ll - value(full.coef)) < 1e-7 and less.coef[1] == 0 and abs(less.ll - value(less.coef)) < 1e-7
    r = np.random.default_rng(32)
    for _ in range(60):
        move = r.normal(0, 0.05, 3)
        assert value(full.coef + move) < full.ll + 1e-9 and value(less.coef + move * [1, 0, 1]) < less.ll + 1e-9


def test_conditional_values_equal_the_recursion(spark):
    r = np.random.default_rng(8)
    for n, share in ((60, 0.5), (500, 0.02), (500, 0.5)):
        X = r.normal(size=(n, 2))
        y = (r.random(n) < share).astype(int)
        y[:2] = 0, 1
        t = pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "y": y, "g": "k", "id": np.arange(n)})
        model = I._Conditional(spark.createDataFrame(t), ["a", "b"], "y", "g", 100)
        for point in ([0.0, 0.0], [2.0, -1.0], [-6.0, 4.0]):  # steps over many deviations of the case count
            ll, grad, info, turn = model.at(np.array(point))
            want = y @ X @ point - log_e(X @ point, int(y.sum()))
            assert abs(ll - want) < 1e-7 * (1 + abs(want))
            h = 1e-5
            slope = [(y @ X[:, j] * 2 * h - log_e(X @ (np.array(point) + h * np.eye(2)[j]), int(y.sum())) + log_e(X @ (np.array(point) - h * np.eye(2)[j]), int(y.sum()))) / (2 * h) for j in range(2)]
            assert np.allclose(grad, slope, rtol=1e-4, atol=1e-4 * n)
            h = 1e-4
            ends = [[model.at(np.array(point) + side * h * np.eye(2)[j]) for side in (1, -1)] for j in range(2)] if point == [2.0, -1.0] and n == 60 else []
            for j, (up, down) in enumerate(ends):
                assert np.allclose(-(up[1] - down[1]) / (2 * h), info[j], rtol=1e-5, atol=1e-6 * n)
                assert np.allclose((up[2] - down[2]) / (2 * h), turn[:, :, j], rtol=1e-4, atol=1e-6 * n)


def test_conditional_on_one_large_stratum_meets_the_unconditional_fit(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=20_000)
    y = (r.random(20_000) < 1 / (1 + np.exp(-(2 * x - 0.5)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "g": 1, "id": np.arange(20_000)})).cache()
    f = I.fit_clogit(df, ["x"], "y", "g", firth=False, piece=6000)
    plain = fit_many(design(df, [], ["x"], "y"), [Spec("f")])[("all", "f")]
    assert f.converged and abs(f.coef[0] - plain.coef[1]) < 1e-3


def test_conditional_report(spark):
    r = np.random.default_rng(9)
    n = 400
    g = r.integers(0, 12, n)
    s = r.normal(size=n) + 0.3 * g
    y = (r.random(n) < 1 / (1 + np.exp(-(s - 0.3 * g)))).astype(int)
    t = spark.createDataFrame(pd.DataFrame({"s": s, "c": r.normal(size=n), "y": y, "g": g, "id": np.arange(n)}))
    row = I.conditional_test(t, "s", ["c"], "y", "g").iloc[0]
    assert row["converged"] and row["local_max"] and row["spread"] < 1e-3 and row["n_strata"] == 12
    assert row["or_sd"] > 1.5 and row["ci_low"] < row["ml_or_sd"] < row["ci_high"] and row["ml_p"] < 0.01


def test_penalised_fit_is_a_maximum(spark):
    """Own data: no point around the fit has a larger penalised likelihood, computed here from its definition."""
    r = np.random.default_rng(15)
    X = np.column_stack([np.ones(90), r.normal(size=(90, 2)), (r.random(90) < 0.1) * 1.0])
    y = np.where(X[:, 3] == 1, 1.0, r.random(90) < 0.4)

    def value(b):
        p = 1 / (1 + np.exp(-X @ b))
        return (y * (X @ b) - np.logaddexp(0, X @ b)).sum() + 0.5 * np.linalg.slogdet((X.T * (p * (1 - p))) @ X)[1]

    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": X[:, 1], "b": X[:, 2], "g": X[:, 3]}))
    f = fit_many(design(df, [], ["a", "b", "g"], "y"), [Spec("f")], firth=True)[("all", "f")]
    assert f.converged and abs(f.ll - value(f.coef)) < 1e-8
    for _ in range(200):
        assert value(f.coef + r.normal(0, 0.02, 4)) < f.ll + 1e-9


def test_weights_equal_replication_and_leave_out(spark):
    r = np.random.default_rng(2)
    X = r.normal(size=(200, 2))
    y = (r.random(200) < 1 / (1 + np.exp(-X[:, 0]))).astype(float)
    w = r.integers(0, 3, 200)
    p = pd.DataFrame({"y": y, "a": X[:, 0], "b": X[:, 1], "code": np.arange(200) % 4, "w": w})
    from pyspark.sql import functions as F

    df = spark.createDataFrame(p)
    weighted = fit_many(design(df, [], ["a", "b"], "y", F.array(F.col("w").cast("double"))), [Spec("w", rep=0)], firth=True)[("all", "w")]
    rep = spark.createDataFrame(p.loc[p.index.repeat(p.w)])
    assert np.allclose(weighted.coef, fit_many(design(rep, [], ["a", "b"], "y"), [Spec("f")], firth=True)[("all", "f")].coef, atol=1e-7)
    lo = fit_many(design(df, [], ["a", "b"], "y", keep=["code"]), [Spec("1", rep=1)], leave_out="code")[("all", "1")]
    sub = fit_many(design(df.filter("code <> 1"), [], ["a", "b"], "y"), [Spec("f")])[("all", "f")]
    assert np.allclose(lo.coef, sub.coef, atol=1e-7)


def test_hc3_brute_force(spark):
    r = np.random.default_rng(4)
    a, b = r.normal(size=150), r.normal(size=150)
    y = 1 + 2 * a + r.normal(size=150) * (1 + np.abs(a))
    t = I.ols_hc3(spark.createDataFrame(pd.DataFrame({"y": y, "a": a, "b": b})), ["a", "b"], "y").set_index("term")
    X = np.column_stack([np.ones(150), a, b])
    inv = np.linalg.inv(X.T @ X)
    beta = inv @ X.T @ y
    e = (y - X @ beta) / (1 - np.einsum("ij,jk,ik->i", X, inv, X))
    se = np.sqrt(np.diag(inv @ (X.T * e**2) @ X @ inv))
    assert np.allclose(t.coef.to_numpy(), beta) and np.allclose(t.se.to_numpy(), se)


def test_increment_lines_against_direct_formulas(spark):
    """Planted signal and noise in clustered data; sandwich and jackknife variances computed here from their definitions on the same fits."""
    r = np.random.default_rng(6)
    g = np.repeat(np.arange(10), 36)
    shift = r.normal(0, 0.6, 10)[g]
    c = r.normal(size=360)
    t = pd.DataFrame({"y": (r.random(360) < 1 / (1 + np.exp(-(0.8 * c + shift)))) * 1.0, "c": c, "gain": shift + r.normal(0, 0.5, 360), "void": r.normal(size=360), "g": g})
    out = I.score_increment_test(spark.createDataFrame(t), ["c"], ["gain", "void"], "y", "g", jackknife=True).set_index(["score", "method"])
    assert out.loc[("gain", "firth_lr"), "p_value"] < 1e-3 and out.loc[("void", "firth_lr"), "p_value"] > 1e-3 and (out["failed"] == 0).all()
    for name in ("gain", "void"):
        z = (t[name] - t[name].mean()) / t[name].std(ddof=0)
        X = np.column_stack([np.ones(360), t["c"], z])

        def fit(keep):
            f = fit_many(design(spark.createDataFrame(pd.DataFrame({"y": t["y"][keep], "c": t["c"][keep], "z": z[keep]})), [], ["c", "z"], "y"), [Spec("f")], firth=True)
            return f[("all", "f")]

        full = fit(np.ones(360, bool))
        p = 1 / (1 + np.exp(-X @ full.coef))
        h = np.einsum("ij,jk,ik->i", X, full.cov, X) * p * (1 - p)
        u = X * (t["y"].to_numpy() - p + h * (0.5 - p))[:, None]
        meat = sum(np.outer(v, v) for v in (u[g == k].sum(0) for k in range(10)))
        assert np.isclose(out.loc[(name, "cluster_sandwich"), "std_error"] ** 2, (full.cov @ meat @ full.cov)[2, 2] * 10 / 9, rtol=1e-4)
        if name == "gain":
            gaps = [fit(g != k).coef[2] - full.coef[2] for k in range(10)]
            assert np.isclose(out.loc[(name, "cluster_jackknife"), "std_error"] ** 2, 9 / 10 * np.sum(np.square(gaps)), rtol=1e-3)


def test_draw_codes_are_poisson_weights_of_the_pass(spark):
    codes, draws = np.arange(4000, dtype=np.int64) * 7919 + 12345, np.arange(200)
    w = hashing.poisson_np(codes, draws)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01 and np.abs(np.corrcoef(w[:, :8].T) - np.eye(8)).max() < 0.08
    assert (hashing.poisson_np(codes[7:9], draws[3:5]) == w[7:9, 3:5]).all()
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"key": "a", "x": [[1.0, v] for v in rng.normal(size=300)], "y": rng.integers(0, 2, 300).astype(float), "draw": codes[:300]})
    listed = pdf.drop(columns="draw").assign(w=[list(r) for r in w[:300, :3]])
    specs = [Spec(str(b), rep=b) for b in (-1, 0, 1, 2)]
    one, two = (fit_many(spark.createDataFrame(p), specs, firth=True) for p in (pdf, listed))
    assert all(np.allclose(one[f].coef, two[f].coef, atol=1e-6) for f in two) and len({round(float(f.coef[1]), 9) for f in one.values()}) == 4


def test_intervals_and_permutation_tests_take_1000_replicates(monkeypatch):
    class Asked(Exception):
        pass

    def ask(*args, **_):
        raise Asked(args)

    monkeypatch.setattr(q_models, "context", lambda spark, sf: (None, ["a"]))
    monkeypatch.setattr(q_models, "shared", lambda df: mock.MagicMock())
    monkeypatch.setattr(q_models, "fused", lambda spark, sf: None)
    monkeypatch.setattr(q_models.G, "compare_arms", ask)
    for name in ("bootstrap_or", "lr_difference", "partial_permutation_test", "confound_test"):
        monkeypatch.setattr(q_models.I, name, ask)
    for query in (q_models.m16, q_models.g15, q_models.g16, q_models.g20, q_models.g21):
        with pytest.raises(Asked) as found:
            query(None, "")
        assert max(a for a in found.value.args[0] if isinstance(a, int)) >= 1000


def test_many_fits_are_dealt_to_all_cores_and_refits_start_at_the_whole_fit(spark, monkeypatch):
    """A small table with many fits lay in one partition; refits of a resample went the whole way from zero."""
    from cohortry.operators import glm

    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"key": "a", "x": [[1.0, v] for v in x], "y": (rng.random(n) < 1 / (1 + np.exp(1 - 2 * x))).astype(float), "draw": rng.integers(0, 2**60, n)})
    rows, seen, real = spark.createDataFrame(pdf).coalesce(1), [], glm._fit_wave
    monkeypatch.setattr(glm, "TASK_CELLS", 1000)
    monkeypatch.setattr(glm, "_fit_wave", lambda rows, *a: seen.append(rows.rdd.getNumPartitions()) or real(rows, *a))
    cold = fit_many(rows, [Spec(str(b), rep=b) for b in range(12)], firth=True)
    assert seen[-1] == 4
    whole = fit_many(rows, [Spec("whole")], firth=True)[("a", "whole")]
    assert seen[-1] == 1
    warm = fit_many(rows, [Spec(str(b), rep=b, start=whole.coef) for b in range(12)], firth=True)
    assert all(np.allclose(warm[f].coef, cold[f].coef, atol=1e-6) and warm[f].converged for f in cold)
    assert sum(f.steps for f in warm.values()) < sum(f.steps for f in cold.values())


def test_the_zoo_trains_on_tasks_that_follow_the_rows(spark, monkeypatch):
    """Each fit is some hundred jobs: with a task for every shuffle partition the five folds of 0.1 GB did not end in time. The neighbours of all folds are one search."""
    from cohortry.operators import models

    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3 == 0), float(rng.normal() + (i % 3 == 0)), float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "unit long, label long, a double, b double").repartition(7)
    folds = df.selectExpr("unit", "unit % 2 as fold")
    searches, tasks = [], []
    monkeypatch.setattr(models, "k_nearest", lambda *x, f=models.k_nearest: searches.append(1) or f(*x))
    monkeypatch.setattr(models, "cut", lambda d, cut=models.cut: ("features" in d.columns and tasks.append(d.rdd.getNumPartitions())) or cut(d))
    got = models.model_zoo(df, ["a", "b"], "label", "unit", folds, [0, 1], arms=("tree", "knn")).toPandas()
    assert searches == [1] and tasks == [1, 1]
    assert len(got) == 240 and not got.duplicated(["arm", "unit"]).any() and (got["fold"] == got["unit"] % 2).all()
    x = np.array([r[2:] for r in rows])
    y, f = np.array([r[1] for r in rows]), np.arange(120) % 2
    for k in (0, 1):
        z = (x - x[f != k].mean(axis=0)) / x[f != k].std(axis=0)
        d = ((z[f == k][:, None] - z[f != k][None]) ** 2).sum(axis=2)
        want = y[f != k][np.argsort(d, axis=1, kind="stable")[:, :5]].mean(axis=1)
        mine = got[(got["arm"] == "knn") & (got["fold"] == k)].sort_values("unit")
        assert np.allclose(mine["prob"], want) and (mine["y"] == y[f == k]).all()
