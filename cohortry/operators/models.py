"""Models on the splits: nested grid choice, reference arms, the model zoo, ensembles, imbalance study, probes (G2 - G9, G23 - G25, M8, M16)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import logit, norm_sf_np, sigmoid
from ..session import cut, shared
from . import metrics as M
from .glm import Spec, balanced, design, fit_many, fits_frame, linear, moments, ridge
from .inference import cross_fit
from .joins import apply_selection
from .metricspace import k_nearest
from .ordered import attach_one
from .splits import grouped_folds, ipw, oversample, smote

GRID = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)
#: Training rows of a task of the model zoo, and of a tile of its neighbour search.
ROWS, CHUNK = 20_000, 262_144
#: Fits of a fold that run at one time.
FITS = 6


def scale_in_fold(df: DataFrame, cols: Sequence[str], fold_keys: Sequence[str], role: str = "role") -> DataFrame:
    """G2. z-scores from the training rows of each fold only. The statistics are one row per fold and go to every task: dealt by fold, a task would read a whole fold."""
    st = df.filter(F.col(role) == "train").groupBy(*fold_keys).agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    t = df.join(F.broadcast(st), list(fold_keys))
    z = {f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in cols}
    return t.withColumns(z).drop(*st.columns[len(fold_keys):])


def log_loss(y, p):
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def nested_cv(df: DataFrame, splits: DataFrame, sets: dict[str, Sequence[str]], y: str, unit: str, k: int, grid: Sequence[float] = GRID, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """G3. Inner-CV choice of C by mean log-loss, refit on the whole training part: (test predictions, inner out-of-fold).

    Every (set, repeat, outer fold, inner fold, C) is one fit of a single batch. Scaling inside the fold is expressed as
    a per-fit penalty from that training set's own SDs, so the rows are stored once.
    """
    roles = splits.groupBy(unit, "repeat").agg(F.map_from_entries(F.collect_list(F.struct(F.col("outer_fold").cast("int"), F.col("inner_fold").cast("int")))).alias("_in"))  # k entries
    member = [F.when((F.col("_in")[f] >= 0) & (F.col("_in")[f] != j), 1.0).otherwise(0.0) for f in range(k) for j in range(-1, k)]
    t = shared(df.join(roles, unit))
    parts = [design(t.withColumn("_set", F.lit(n)), ["_set", "repeat"], cols, y, F.array(*member), [unit, "repeat", "_in"]) for n, cols in sets.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = shared(rows)
    combos = [(f, j) for f in range(k) for j in range(-1, k)]
    mom = moments(rows, range(len(combos)))
    specs: dict[str, list[Spec]] = {}
    for (key, r), (n, _, sd, n1) in mom.items():
        f, j = combos[r]
        if 0 < n1 < n:  # a one-class training set is skipped
            specs.setdefault(key, []).extend(Spec(f"{f}|{j}|{C!r}", rep=r, penalty=ridge(sd, C), class_weight=balanced(n, n1) if weighted else (1.0, 1.0)) for C in grid)
    fits = fits_frame(df.sparkSession, fit_many(rows, specs))
    part = F.split("fit", r"\|")
    fits = fits.select("key", part[0].cast("int").alias("fold"), part[1].cast("int").alias("inner"), part[2].cast("double").alias("C"), "coef")
    long = rows.select("key", unit, "repeat", "x", "y", F.explode("_in").alias("fold", "inner"))
    scored = shared(long.join(fits, ["key", "fold", "inner"]).withColumn("prob", sigmoid(linear("x", "coef"))).drop("x", "coef"))
    loss = scored.filter("inner >= 0").groupBy("key", "fold", "C").agg(F.avg(log_loss(F.col("y"), F.col("prob"))).alias("loss"))
    best = loss.groupBy("key", "fold").agg(F.min_by("C", F.struct(F.round("loss", 12), "C")).alias("C"))
    chosen = scored.join(best, ["key", "fold", "C"]).withColumn("arm", F.split("key", r"\|")[0])
    cols = ["arm", unit, "repeat", F.col("fold").cast("long").alias("fold"), "y", "prob", "C"]
    return chosen.filter("inner = -1").select(*cols), chosen.filter("inner >= 0").select(*cols, "inner")


def reference_arms(df: DataFrame, sets: dict[str, Sequence[str]], y: str, unit: str, folds: DataFrame, k: int, keep: Sequence[str] = ()) -> DataFrame:
    """G4. Context-only arms on given folds: balanced logistic regression (C = 1) on in-fold standardised features."""
    return cross_fit(df, sets, y, unit, folds, k, C=1.0, weighted=True, standardise=True, keep=keep)


def onehot_columns(df: DataFrame, cat: Sequence[str], limit: int = 1000) -> tuple[DataFrame, list[str]]:
    """G5. One indicator per level, NULL as its own level.

    A level unseen in a training fold has an all-zero column there; under the ridge penalty its coefficient is exactly 0,
    which is the 'unknown ignored' rule, so one level list serves all folds. The list is size-checked.
    """
    names = []
    for c in cat:
        v = F.coalesce(F.col(c).cast("string"), F.lit("<null>"))
        levels = [r[0] for r in df.select(v.alias("v")).distinct().orderBy("v").limit(limit + 1).collect()]
        if len(levels) > limit:
            raise ValueError(f"{c} has more than {limit} levels; it is not a categorical column")
        for i, lv in enumerate(levels):
            names.append(f"oh_{c}_{i}")
            df = df.withColumn(names[-1], (v == lv).cast("double"))
    return df, names


def onehot_logit(df: DataFrame, cat: Sequence[str], num: Sequence[str], y: str, unit: str, folds: DataFrame, k: int) -> DataFrame:
    """G5. Mixed categorical / numeric baseline; indicators keep scale 1, numerics are scaled in the fold."""
    t, names = onehot_columns(df, cat)
    return cross_fit(t, {"onehot": [*names, *num]}, y, unit, folds, k, C=1.0, standardise={"onehot": [False] * len(names) + [True] * len(num)})


def model_zoo(df: DataFrame, cols: Sequence[str], y: str, unit: str, folds: DataFrame, fold_list: Sequence[int], arms: Sequence[str] = ("nb", "tree", "rf", "gbt", "mlp", "knn", "svm"), seed: int = 0) -> DataFrame:
    """G6. Out-of-fold scores of the Spark ML classifiers (and exact kNN vote) on the same folds: (arm, unit, y, fold, prob).

    Features are scaled with training statistics of each fold. The loop is over folds, whose arms are fitted side by side; each fit is a distributed job, whose tasks follow its
    rows: a fit is some hundred small jobs, and empty or tiny tasks would take most of its time. The neighbours of all folds are one search.
    """
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    make = {
        "nb": lambda: NaiveBayes(modelType="gaussian"), "tree": lambda: DecisionTreeClassifier(maxDepth=5, seed=seed),
        "rf": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed), "gbt": lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=seed),
        "mlp": lambda: MultilayerPerceptronClassifier(layers=[len(cols), 8, 2], maxIter=50, seed=seed), "svm": lambda: LinearSVC(maxIter=50, regParam=0.01),
    }
    own = F.col("own")
    t = df.join(folds.select(unit, F.col("fold").alias("own")), unit).withColumn("fold", F.explode(F.array(*[F.lit(f) for f in fold_list])))
    s = scale_in_fold(t.withColumn("role", F.when(own == F.col("fold"), "test").otherwise("train")), cols, ["fold"])
    s = cut(s.select("fold", unit, F.col(y).cast("double").alias("label"), "role", F.array(*[f"{c}_z" for c in cols]).alias("v")))
    train, test = s.filter("role = 'train'"), s.filter("role = 'test'")
    most = train.groupBy("fold").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    out = None
    for f in fold_list:
        features = lambda d, f=f: d.filter(F.col("fold") == f).select(unit, "label", array_to_vector("v").alias("features"))
        rows = cut(features(train).repartition(-(-most // ROWS) or 1, unit).sortWithinPartitions(unit))

        def fitted(a: str, f=f, features=features, rows=rows) -> DataFrame:
            m = make[a]().fit(rows).transform(features(test))
            score = sigmoid(vector_to_array("rawPrediction")[1]) if a == "svm" else vector_to_array("probability")[1]
            return m.select(F.lit(a).alias("arm"), unit, F.col("label").cast("long").alias("y"), F.lit(f).cast("long").alias("fold"), score.alias("prob"))

        in_thread = inheritable_thread_target(df.sparkSession)
        with ThreadPool(FITS) as pool:
            parts = pool.map(lambda run: run(), [in_thread(partial(fitted, a)) for a in arms if a != "knn"], 1)
        if parts:
            scored = cut(reduce(DataFrame.unionByName, parts))
            out = scored if out is None else out.unionByName(scored)
    if "knn" in arms:
        # few columns: the boxes inside a tile exclude far more than cells around pivots, so a fold is one cell of large chunks
        nn = k_nearest(test, train, unit, "v", 5, ["fold"], CHUNK, 1).join(train.select("fold", F.col(unit).alias("nb"), F.col("label").alias("_l")), ["fold", "nb"])
        p = nn.groupBy("fold", unit).agg(F.avg("_l").alias("prob")).join(test.select("fold", unit, "label"), ["fold", unit])
        p = p.select(F.lit("knn").alias("arm"), unit, F.col("label").cast("long").alias("y"), F.col("fold").cast("long").alias("fold"), "prob")
        out = p if out is None else out.unionByName(p)
    return out


def soft_vote(preds: DataFrame, keys: Sequence[str], arm: str = "arm", weights: DataFrame | None = None, weight: str = "weight") -> DataFrame:
    """G7. Mean probability over arms, optionally weighted (for example by inner AUC)."""
    if weights is None:
        return preds.groupBy(*keys).agg(F.avg("prob").alias("prob"))
    on = [c for c in weights.columns if c != weight]
    t = preds.join(F.broadcast(cut(weights)), on)  # one row per arm and fold; else every branch of a ranking of the votes repeats that of the weights
    return t.groupBy(*keys).agg((F.sum(F.col("prob") * F.col(weight)) / F.sum(weight)).alias("prob"))


def best_arms(scores: DataFrame, by: Sequence[str], k: int, arm: str = "arm") -> DataFrame:
    """G7. The k arms with the highest AUC per fold (one row per arm)."""
    rn = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("auc"), arm))
    return scores.withColumn("_rn", rn).filter(F.col("_rn") <= k).select(*by, arm)


def stack(preds: DataFrame, unit: str, y: str, arms: Sequence[str], folds: DataFrame, k: int) -> DataFrame:
    """G7. Logistic stacking on out-of-fold arm probabilities, itself cross-fitted."""
    wide = preds.groupBy(unit, y).agg(*[F.avg(F.when(F.col("arm") == a, F.col("prob"))).alias(f"p_{a}") for a in arms])
    return cross_fit(wide, {"stack": [f"p_{a}" for a in arms]}, y, unit, folds, k, C=1.0, standardise=True)


VARIANTS = ("plain", "balanced", "ipw", "oversample", "smote")


def variant_study(df: DataFrame, cols: Sequence[str], y: str, unit: str, cell: Sequence[str], folds: DataFrame, k: int, variants: Sequence[str] = VARIANTS, C: float = 1.0, seed: str = "v") -> DataFrame:
    """G8. The same model and folds under different training-set treatments: out-of-fold (variant, unit, y, fold, prob).

    Synthetic and repeated rows exist in training parts only. All variants and folds are one batch of fits.
    """
    base = cut(df.join(folds.select(unit, F.col("fold").alias("own")), unit).withColumn("vec", F.array(*[F.col(c).cast("double") for c in cols])))
    train = base.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter("own <> fold")
    train = cut(train.select(unit, y, "fold", "vec", *[c for c in cell if c not in (unit, y)]))
    parts = {}
    for v in variants:
        if v in ("plain", "balanced"):
            parts[v] = train.select("fold", y, "vec", F.lit(1.0).alias("wt"))
        elif v == "ipw":
            parts[v] = ipw(train, cell, y, ["fold"], "wt").select("fold", y, "vec", "wt")
        elif v == "oversample":
            extra = oversample(train, unit, y, ["fold"], seed).groupBy("fold", unit).agg(F.count(F.lit(1)).alias("_x"))
            parts[v] = train.join(extra, ["fold", unit], "left").select("fold", y, "vec", (1.0 + F.coalesce("_x", F.lit(0))).alias("wt"))
        else:
            minority = train.groupBy("fold", y).agg(F.count(F.lit(1)).alias("c")).groupBy("fold").agg(F.min_by(y, "c").alias(y))
            syn = smote(train, unit, "vec", y, ["fold"], seed).select("fold", "vec").join(minority, "fold")
            parts[v] = train.select("fold", y, "vec").unionByName(syn.select("fold", y, "vec")).withColumn("wt", F.lit(1.0))
    rows = None
    for v, d in parts.items():
        w = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.when(f == F.col("fold"), F.col("wt")).otherwise(0.0))
        r = d.select(F.lit(v).alias("key"), F.concat(F.array(F.lit(1.0)), F.col("vec")).alias("x"), F.col(y).cast("double").alias("y"), w.alias("w"))
        rows = r if rows is None else rows.unionByName(r)
    rows = cut(rows)
    specs = {}
    for (v, f), (n, _, sd, n1) in moments(rows, range(k)).items():
        specs.setdefault(v, []).append(Spec(str(f), rep=f, penalty=ridge(sd, C), class_weight=balanced(n, n1) if v == "balanced" else (1.0, 1.0)))
    fits = fits_frame(df.sparkSession, fit_many(rows, specs)).select(F.col("key").alias("variant"), F.col("fit").cast("int").alias("own"), "coef")
    test = base.withColumn("x", F.concat(F.array(F.lit(1.0)), F.col("vec"))).join(fits, "own")
    return test.select("variant", unit, F.col(y).alias("y"), F.col("own").cast("long").alias("fold"), sigmoid(linear("x", "coef")).alias("prob"), *[c for c in cell if c not in (unit, y)])


def variant_metrics(oof: DataFrame, strata: Sequence[str]) -> DataFrame:
    """G8. AUC, stratified AUC, threshold metrics at 0.5 and calibration moments per variant."""
    a = M.auc(oof, "y", "prob", ["variant"]).select("variant", "auc")
    s = M.stratified_auc(oof, "y", "prob", strata, ["variant"]).select("variant", F.col("auc").alias("auc_within"))
    c = M.confusion_metrics(oof, "y", "prob", 0.5, ["variant"]).select("variant", "balacc", "sens", "spec", "mcc")
    b = M.calibration_moments(oof, "y", "prob", ["variant"]).select("variant", "brier", "mean_minus_prevalence")
    return a.join(s, "variant").join(c, "variant").join(b, "variant")


def nested_choice(inner: DataFrame, test: DataFrame, y: str, unit: str, keys: Sequence[str] = ("repeat", "fold")) -> DataFrame:
    """G9. Per fold the arm with the best inner AUC, and that arm's test AUC."""
    fused = shared(inner.groupBy(*keys, "arm", unit, y).agg(F.avg("prob").alias("prob")))  # a ranking reads its rows three times
    sc = M.auc(fused, y, "prob", [*keys, "arm"])
    sel = cut(sc.groupBy(*keys).agg(F.max_by("arm", F.struct(F.round("auc", 12), "arm")).alias("selected")))  # one row per fold; else every branch of the second ranking repeats the first
    t = test.groupBy(*keys, "arm", unit, y).agg(F.avg("prob").alias("prob"))
    return M.auc(apply_selection(t, sel, "arm", keys), y, "prob", [*keys, "arm"])


class NoTraining(ValueError):
    """Nothing is left to choose or fit a model on."""


def grid_choice(df: DataFrame, cols: Sequence[str], y: str, unit: str, folds: DataFrame, k: int, grid: Sequence[float]) -> tuple[float, np.ndarray]:
    """C with the smallest out-of-fold log-loss on the given folds, and the coefficients refitted on all rows."""
    w = folds.select(unit, F.col("fold").alias("own"), F.array(*[(F.col("fold") != f).cast("double") for f in range(k)]).alias("w"))
    rows = shared(design(df.join(w, unit), [], cols, y, F.col("w"), ["own"]))
    mom = moments(rows, [-1, *range(k)])
    specs = [Spec(f"{r}|{C!r}", rep=r, penalty=ridge(sd, C), class_weight=balanced(n, n1)) for (_, r), (n, _, sd, n1) in mom.items() if 0 < n1 < n for C in grid]
    res = fit_many(rows, specs)
    fits = fits_frame(df.sparkSession, res)
    part = F.split("fit", r"\|")
    s = rows.join(fits.select(part[0].cast("long").alias("own"), part[1].cast("double").alias("C"), "coef"), "own").withColumn("p", sigmoid(linear("x", "coef")))
    loss = {r["C"]: r["loss"] for r in s.groupBy("C").agg(F.avg(log_loss(F.col("y"), F.col("p"))).alias("loss")).collect()}  # one row per grid point
    if not loss:
        raise NoTraining("no fold has both labels in its training part, so no C can be chosen")
    best = min(loss, key=lambda c: (round(loss[c], 12), c))
    return best, res[("all", f"-1|{best!r}")].coef


def context_probe(df: DataFrame, cols: Sequence[str], case: str, flag: str, unit: str, folds: DataFrame, k: int, C: float = 1.0) -> DataFrame:
    """G23. Probe of a context flag trained inside cases, out-of-fold there and applied to controls by the mean of the fold
    models: (unit, case, flag, proxy). The proxy can re-enter the increment test as a score."""
    cases = df.filter((F.col(case) == 1) & F.col(flag).isNotNull())
    w = folds.select(unit, F.col("fold").alias("own"), F.array(*[(F.col("fold") != f).cast("double") for f in range(k)]).alias("w"))
    rows = shared(design(cases.join(w, unit), [], cols, flag, F.col("w"), [unit, "own"]))
    mom = moments(rows, range(k))
    specs = [Spec(str(r), rep=r, penalty=ridge(sd, C), class_weight=balanced(n, n1)) for (_, r), (n, _, sd, n1) in mom.items() if 0 < n1 < n]
    fits = shared(fits_frame(df.sparkSession, fit_many(rows, specs)).select(F.col("fit").cast("long").alias("own"), "coef"))
    inside = rows.join(fits, "own").select(unit, F.lit(1).alias("case"), F.col("y").alias("flag"), linear("x", "coef").alias("proxy"))
    ctrl = df.filter(F.col(case) == 0).select(unit, F.col(flag).cast("double").alias("flag"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in cols]).alias("x"))
    models = fits.agg(F.collect_list("coef").alias("ms")).scalar()  # k coefficient vectors
    outside = ctrl.withColumn("ms", models).withColumn("proxy", F.aggregate(F.transform("ms", lambda m: linear(F.col("x"), m)), F.lit(0.0), lambda a, v: a + v) / F.size("ms"))
    return inside.unionByName(outside.select(unit, F.lit(0).alias("case"), "flag", "proxy"))


def probe_target(df: DataFrame, kind: str, label: str, sex: str | None = None, phase: str | None = None) -> DataFrame:
    """G24. Target builder: `label`, `sex`, or `phase` (late vs early, cases only, unknown dropped)."""
    if kind == "label":
        return df.withColumn("target", F.col(label).cast("double"))
    if kind == "sex":
        return df.withColumn("target", F.col(sex).cast("double")).filter("target is not null")
    return df.filter((F.col(label) == 1) & F.col(phase).isin("early", "late")).withColumn("target", (F.col(phase) == "late").cast("double"))


def probe_arm(df: DataFrame, cols: Sequence[str], group: str, unit: str, k: int = 5, seed: int = 0, C: float = 1.0) -> DataFrame:
    """G24. Group-disjoint CV of a target; a fold whose training part has one class gives no predictions."""
    t = shared(df.withColumn("_t", F.col("target").cast("int")))
    g = grouped_folds(t, group, "_t", k, [seed]).select(group, "fold")
    t = shared(t.join(g, group))
    n = t.agg(F.sum("target").alias("n1"), F.count(F.lit(1)).alias("n"))
    per = attach_one(t.groupBy("fold").agg(F.sum("target").alias("t1"), F.count(F.lit(1)).alias("tn")), n)
    good = per.filter((F.col("n1") > F.col("t1")) & (F.col("n") - F.col("n1") > F.col("tn") - F.col("t1"))).select("fold")
    o = cross_fit(t.drop("fold"), {"probe": cols}, "target", unit, t.select(unit, "fold"), k, C=C, weighted=True, standardise=True)
    return o.join(good, "fold", "left_semi")


def score_external(train: DataFrame, external: DataFrame, exclude: DataFrame, cols: Sequence[str], y: str, unit: str, group: str, k: int = 5, grid: Sequence[float] = GRID, seed: int = 0) -> DataFrame:
    """G25. Train on the cohort minus the excluded units (C from group-disjoint folds) and score unseen rows. Where the exclusion leaves nothing to choose C on, there is no
    model: every row comes back with neither probability nor C."""
    t = shared(train.join(exclude.select(unit), unit, "left_anti"))
    folds = t.select(unit, group).join(grouped_folds(t, group, y, k, [seed]).select(group, "fold"), group).select(unit, "fold")
    try:
        C, coef = grid_choice(t, cols, y, unit, folds, k, grid)
    except NoTraining:
        return external.withColumns({"C": F.lit(None).cast("double"), "prob": F.lit(None).cast("double")})
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in cols])
    return external.withColumn("C", F.lit(C)).withColumn("prob", sigmoid(linear(x, F.array(*[F.lit(float(v)) for v in coef]))))


def calibration(df: DataFrame, y: str, p: str, by: str) -> pd.DataFrame:
    """M8. Brier, calibration in the large, mean |logit| and the calibration slope (unpenalised logistic on logit p) with CI."""
    d = df.withColumn("_lp", logit(p))
    fits = fit_many(design(d, [by], ["_lp"], y), [Spec("slope")])
    mom = M.calibration_moments(df, y, p, [by]).toPandas().set_index(by)  # one row per group
    out = []
    for (key, _), f in sorted(fits.items()):
        b, se = float(f.coef[1]), float(f.se[1])
        out.append({by: key, **mom.loc[key].to_dict(), "slope": b, "slope_low": b - 1.96 * se, "slope_high": b + 1.96 * se, "converged": f.converged})
    return pd.DataFrame(out)


def compare_arms(preds: DataFrame, draws: int, seed: str, pairs: Sequence[tuple[str, str]], y: str, unit: str, ratio: float) -> DataFrame:
    """M16. One record per arm pair: fold difference with the corrected t, pooled difference with its paired interval, and the
    median over repeats of the DeLong p. `preds` is fused (arm, repeat, fold, unit, y, prob)."""
    fold = M.auc(preds, y, "prob", ["arm", "repeat", "fold"])
    d = M.pair_difference(fold, ["repeat", "fold"], "arm", "auc", pairs)
    nb = M.nadeau_bengio_p(M.nadeau_bengio(d, "delta", ratio, ["arm_a", "arm_b"])).withColumnsRenamed({"mean": "fold_delta", "n": "n_folds", "t": "nb_t", "p": "nb_p", "p_one_sided": "nb_p_one_sided"})
    pooled = shared(preds.groupBy("arm", unit, y).agg(F.avg("prob").alias("prob")))
    ci = M.auc_delta_interval(pooled, y, "prob", "arm", pairs, unit, draws, seed).withColumnsRenamed({"delta": "pooled_delta"})
    dl = M.two_sided(M.delong(preds.select("repeat", "arm", unit, y, "prob"), y, "prob", "arm", pairs, ["repeat"], unit))
    dl = dl.groupBy("arm_a", "arm_b").agg(F.percentile("p", F.lit(0.5)).alias("delong_p_median"))  # one value per repeat
    return nb.join(ci, ["arm_a", "arm_b"]).join(dl, ["arm_a", "arm_b"])
