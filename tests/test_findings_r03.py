"""Queries on rows that only larger tables hold, against their SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.operators import gates, joins, metricspace, models
from cohortry.operators.clean import GuardError
from cohortry.plans import ORACLES, QUERIES


def against_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{t}.parquet"))
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want
    return want


def test_an_owner_with_the_first_six_digits_of_the_order_is_a_conflict(spark, tmp_path):
    rows = [(1099991, 1099999, 1, "A"), (109999, 1099995, 1, "A"), (999999, 9999995, 2, "A"), (1099991, 1099991, 1, "A"), (12, 12, 1, "N"), (12, 13, 1, "A")]
    got = against_sql(spark, tmp_path, "p08_parse_names", lineitem=("l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string", rows))
    assert sum(r[2] for r in got if r[0]) == 4


def test_numbers_with_one_character_between_them_count_as_in_sql(spark, tmp_path):
    pages = [(3, "u", "500003,500003 500003 500003\n500006"), (6, "u", "500006"), (9, "u", "x500009.")]
    talks = [(3, 0, "a", "500003/500006"), (4, 1, "a", "500006\n")]
    against_sql(spark, tmp_path, "d04_scan_id_leaks", pages=("page_id long, url string, html string", pages), conversations=("conv_id long, turn int, role string, text string", talks))


def test_poisson_counts_end_where_the_sql_ends(spark, tmp_path):
    # unit 966930 has the uniform 0.99999993 in draw 2: a count of 10, which nine steps do not reach
    got = against_sql(spark, tmp_path, "r14_poisson_weights", documents=("doc_id long, text string, lang string, source string, n_chars long", [(966930, "a b", "en", "s", 3)]),
                      labels=("doc_id long, quality int, toxic int", [(966930, 1, 0)]))
    assert (2, 1, 9) in got


def test_a_count_of_six_digits_is_no_leak_and_an_id_is(spark, tmp_path):
    ids = spark.range(100000, 100010).withColumnRenamed("id", "unit")
    table = spark.createDataFrame([("en", 100003)], "stratum string, n long")
    with pytest.raises(GuardError):
        gates.publish(table, ids, ids, "unit", str(tmp_path / "a"), str(tmp_path / "b"))
    gates.publish(table, ids, ids, "unit", str(tmp_path / "c"), str(tmp_path / "d"), counts=["n"])
    assert spark.read.json(str(tmp_path / "d")).first()["n"] == 100003
    with pytest.raises(GuardError):
        gates.publish(table.withColumn("stratum", F.lit("unit 100004")), ids, ids, "unit", str(tmp_path / "e"), str(tmp_path / "f"), counts=["n"])


def test_external_rows_come_back_when_the_exclusion_leaves_no_training_row(spark):
    rows = [(i, float(i % 5), i % 2, str(i % 3)) for i in range(30)]
    v = spark.createDataFrame(rows, "unit long, d0 double, label long, grp string")
    for out in (v.select("unit"), v.filter("grp <> '0'").select("unit")):  # all, all but one group
        got = models.score_external(v, v.select("unit", "d0"), out, ["d0"], "label", "unit", "grp", 5, grid=(1.0,)).collect()
        assert len(got) == 30 and all(r["prob"] is None and r["C"] is None for r in got)


def test_the_plan_of_the_best_threshold_is_not_repeated_in_its_branches(spark):
    """The second ranking held the first one in every branch: 1.9 million characters of plan, kept by the driver for every stage."""
    df = QUERIES["m06_best_threshold"](spark, "/root/testdata/sf0.001")
    assert len(df._jdf.queryExecution().toString()) < 200_000 and df.count() == 45


def test_the_registry_ranks_only_the_groups_that_it_stores(spark, monkeypatch):
    from cohortry.operators import metrics

    seen = []
    monkeypatch.setattr(metrics, "auc", lambda df, *x, f=metrics.auc: seen.append({tuple(r) for r in df.select("repeat", "fold").distinct().collect()}) or f(df, *x))
    assert QUERIES["s06_upsert_registry"](spark, "/root/testdata/sf0.001").count() == 21
    assert seen == [{(0, 0), (1, 0)}]


def test_a_row_is_sent_to_as_many_tasks_whatever_the_size_of_the_table():
    """Every cell used to send its rows to every other cell it could not exclude, in blocks of a fixed number of rows."""
    for n in (10_000, 100_000, 1_000_000):
        size = np.full(1000, n // 1000)
        *_, block = metricspace.Cells(None, np.zeros((1000, 1)), np.zeros(1000), size, 2048).pieces()
        assert block.max() <= metricspace.BLOCKS and np.bincount(block).max() * n // 1000 <= 2 * metricspace.block_rows(n, 2048)


@pytest.mark.parametrize("misled", [False, True])
def test_similarity_of_rows_without_clusters_is_exact_also_where_the_sample_misleads(spark, monkeypatch, misled):
    r = np.random.default_rng(3)
    x, e = r.normal(size=(500, 8)), np.arange(500) % 7
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(500), "e": e, "v": x.tolist()}))
    if misled:
        monkeypatch.setattr(joins, "_sampled_quantile", lambda *_: (980, (990, 995)))
    u = x - x.mean(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    i, j = np.triu_indices(500, 1)
    i, j = i[e[i] != e[j]], j[e[i] != e[j]]
    s = np.round((u[i] * u[j]).sum(axis=1), 6)
    got = joins.similarity_summary(df, "id", "v", "e", 0.7, rows=60).first()
    assert (got["pairs"], got["flagged"]) == (len(s), int((s >= 0.7).sum())) and got["q_corr"] == pytest.approx(np.sort(s)[int(np.ceil(0.99 * len(s))) - 1], abs=1e-6)
    best = np.lexsort((j, i, -s))[:50]
    assert [(r["a"], r["b"]) for r in joins.near_duplicates(df, "id", "v", "e", rows=60).collect()] == list(zip(i[best].tolist(), j[best].tolist(), strict=True))
    space = joins._similarity_cells(df, "id", "v", "e", 60)
    assert space.tiles(np.ones((len(space.size),) * 2, dtype=bool), lambda parts: pd.DataFrame({"n": [sum(len(a["id"]) * len(b["id"]) if k is None else int(k.sum()) for a, b, k in parts)]}), "n long", "id").agg(F.sum("n")).first()[0] == 500 * 499 // 2


def test_no_row_of_a_neighbour_search_carries_the_pivots_of_its_group(spark, monkeypatch):
    """Each query row was stored and sent with all pivots of its group: 64 vectors beside its one."""
    kept = []
    monkeypatch.setattr(metricspace, "shared", lambda df, f=metricspace.shared: kept.append(f(df)) or kept[-1])
    df = spark.createDataFrame([(i, i % 2, [float(i % 7), float(i % 5)]) for i in range(40)], "id long, g int, v array<double>")
    assert metricspace.k_nearest(df, df, "id", "v", 2, ["g"]).count() == 80
    assert [t.count() for t in kept if any("_piv" in c for c in t.columns)] == [2, 2]


def test_fits_read_rows_as_matrices_of_an_arrow_batch():
    """A pass over the rows made one object per row and sorted frames by design; now a column is one buffer, also in a slice of a batch with designs of different width."""
    import pyarrow as pa

    from cohortry.operators import glm

    batch = pa.RecordBatch.from_pydict({"key": ["z", "a", "b", "a"], "x": [[9.0], [1.0, 800.0], [1.0], [1.0, -800.0]], "y": [0.0, 1.0, 1.0, 1.0], "w": [[0.0], [1.0], [1.0], [2.0]], "code": [9, 0, 1, 2]}).slice(1)
    got = dict(glm._blocks(batch))
    assert got["a"]["x"].tolist() == [[1.0, 800.0], [1.0, -800.0]] and got["b"]["x"].tolist() == [[1.0]] and got["a"]["code"].tolist() == [0, 2]
    specs = [glm.Spec("all"), glm.Spec("part", rep=0), glm.Spec("out", rep=2)]
    assert glm._weights(got["a"], specs[:2], None).tolist() == [[1.0, 1.0], [1.0, 2.0]] and glm._weights(got["a"], specs[::2], "code").tolist() == [[1.0, 1.0], [1.0, 0.0]]
    sums = glm._row_sums(got["a"]["x"], got["a"]["y"], np.ones((2, 1)), np.array([[0.0, 1.0]]), False, glm._tri(2), None)
    assert sums[0, :3].tolist() == [-800.0, 1.0, -800.0]
