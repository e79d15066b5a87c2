"""Plans and passes whose cost must not grow faster than the tables."""

from pyspark.sql import functions as F

from cohortry.operators import joins, models


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_grid_counts_without_a_join(spark):
    entities = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "e long")
    facts = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (3, 9), (4, 1), (None, 1), (3, None)], "e long, s int")
    g = joins.complete_grid(entities, facts, "e", "s", [1, 2])
    assert g.columns == ["e", "s", "n", "status"] and dict(g.dtypes) == {"e": "bigint", "s": "bigint", "n": "bigint", "status": "string"}
    got = sorted((r["e"] or 0, r["s"], r["n"], r["status"]) for r in g.collect())
    assert got == [(0, 1, 0, "MISSING"), (0, 2, 0, "MISSING"), (1, 1, 2, "MULTIPLE"), (1, 2, 0, "MISSING"), (2, 1, 0, "MISSING"), (2, 1, 0, "MISSING"),
                   (2, 2, 1, "OK"), (2, 2, 1, "OK"), (3, 1, 0, "MISSING"), (3, 2, 0, "MISSING")]
    assert "Join" not in plan(g) and plan(g.groupBy("e").count()).count("Exchange hashpartitioning") == 1


def test_statistics_of_a_fold_go_to_the_rows(spark):
    df = spark.createDataFrame([(i, i % 2, "test" if i % 5 == 0 else "train", float(i)) for i in range(40)], "unit long, fold int, role string, x double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        z = models.scale_in_fold(df, ["x"], ["fold"])
        assert "BroadcastHashJoin" in plan(z) and "SortMergeJoin" not in plan(z)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    means = z.filter("role = 'train'").groupBy("fold").agg(F.avg("x_z").alias("m"), F.stddev_pop("x_z").alias("s")).collect()
    assert len(means) == 2 and all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in means)


def test_a_choice_among_arms_is_made_once(spark):
    rows = [(0, f, a, u, u % 2, u % 2 + (0.1 * (u % 3) if a == "good" else 3.0 * (u % 5))) for f in (0, 1) for a in ("good", "bad") for u in range(20)]
    raw = spark.createDataFrame(rows, "repeat long, fold long, arm string, unit long, label long, p double")
    inner, test = raw.withColumn("prob", F.sqrt("p")), raw.withColumnRenamed("p", "prob")
    choice = models.nested_choice(inner, test, "label", "unit")
    assert [(r["fold"], r["arm"], r["auc"]) for r in choice.sort("fold").collect()] == [(0, "good", 1.0), (1, "good", 1.0)]
    assert "SQRT" not in plan(choice)  # the ranking of the inner predictions is no part of the second ranking's branches
    weights = raw.groupBy("arm", "fold").agg(F.sqrt(F.max("p")).alias("weight"))
    votes = models.soft_vote(test, ["fold", "unit"], weights=weights)
    assert votes.count() == 40 and "SQRT" not in plan(votes)
