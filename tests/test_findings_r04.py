"""Queries on rows that only larger tables hold, against their SQL; inputs that grow without bound."""

import datetime
import hashlib
import os
import threading
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from cohortry.operators import metricspace, models
from cohortry.sources import tables
from test_findings_r03 import against_sql


def test_poisson_weights_take_the_steps_of_the_sql(spark, tmp_path):
    # the uniform of unit 58829 in draw 12 (0.9999898008) lies between P(Poisson(1) <= 7) and the eighth step of the SQL
    got = against_sql(spark, tmp_path, "r14_poisson_weights", documents=("doc_id long, text string, lang string, source string, n_chars long", [(58829, "a b", "en", "s", 3)]),
                      labels=("doc_id long, quality int, toxic int", [(58829, 1, 0)]))
    assert (12, 1, 7) in got


def test_a_quantile_between_equal_values_is_that_value(spark, tmp_path):
    # the quietest frames of a user have one value: all of them are in the profile
    at = datetime.datetime(2024, 1, 1)
    rows = [(100 * u + i, at + datetime.timedelta(minutes=i), u, "view", round(1.37 * u, 2) + (9.0 if i > 7 else 0.0), "") for u in range(1, 41) for i in range(15)]
    got = against_sql(spark, tmp_path, "w08_quiet_profile", events=("event_id long, ts timestamp, user_id long, event_type string, value double, props string", rows))
    assert [r[0] for r in got] == [8] * 120


def test_a_file_beyond_two_gigabytes_is_in_the_inventory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    with open(tmp_path / "a" / "large %20.parquet", "wb") as f:  # sparse: takes no disk
        os.truncate(f.fileno(), 2**31 + 5)
    (tmp_path / "small.txt").write_bytes(b"x")
    with open(tmp_path / "a" / "large %20.parquet", "rb") as f:
        want = hashlib.file_digest(f, "sha256").hexdigest()
    got = {r["name"]: (r["kind"], r["size"], r["sha256"]) for r in tables.scan_inventory(spark, str(tmp_path), ["parquet"]).collect()}
    assert got == {"large %20.parquet": ("media", 2**31 + 5, want), "small.txt": ("other", 1, hashlib.sha256(b"x").hexdigest())}


def test_a_tile_of_the_neighbour_search_compares_near_rows_only():
    rng = np.random.default_rng(0)
    y = np.abs(rng.standard_t(3, (40000, 4))).round(2)
    y[::3] = y[0]  # many equal rows
    y[7, 0] = np.nan
    key, of = np.arange(len(y)), np.arange(0, len(y), 10)
    tracemalloc.start()
    i, j, d2 = metricspace.nearest_rows(y[of], y, key[of], key, 5)
    assert tracemalloc.get_traced_memory()[1] < 400e6  # all pairs are 1.28 GB
    tracemalloc.stop()
    got = {}
    for a, b, d in zip(i, j, d2):
        got.setdefault(int(a), []).append((int(b), d))
    assert len(got) == 4000 and all(len(v) == 5 for v in got.values())
    for a in range(0, 4000, 40):
        d = np.maximum((y[of[a]] ** 2).sum() + (y * y).sum(1) - 2 * y @ y[of[a]], 0.0).round(9)
        d[of[a]] = np.inf
        assert [b for b, _ in got[a]] == np.lexsort((key, np.nan_to_num(d, nan=np.inf)))[:5].tolist()


def test_the_arms_of_a_fold_are_fitted_side_by_side(spark, monkeypatch):
    from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes

    both = threading.Barrier(2, timeout=60)  # one fit alone does not pass
    for c in (DecisionTreeClassifier, NaiveBayes):
        monkeypatch.setattr(c, "fit", lambda self, rows, f=c.fit: both.wait() >= 0 and f(self, rows))
    df = spark.range(60).select(F.col("id").alias("unit"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3 == 0).cast("long").alias("label"))
    got = models.model_zoo(df, ["a"], "label", "unit", df.select("unit", (F.col("unit") % 2).alias("fold")), [0], arms=("nb", "tree")).collect()
    assert sorted({r["arm"] for r in got}) == ["nb", "tree"] and len(got) == 60
