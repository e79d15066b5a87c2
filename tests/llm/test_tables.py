"""Operators on whole tables against brute force: neighbours, toxicity, near duplicates, URL rules, perspectives, pipeline."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest
from helpers import SCHEMA, SF, no_docs, odd_docs
from pyspark.sql import functions as F

import corpus_pipeline
from cohortry.llm import ann, common, nearjoin, perspectives, toxicity, urlrules
from cohortry.llm.queries import ORACLES, QUERIES


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def brute_neighbours(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    out = {}
    for i, v in queries:
        s = x @ np.array(v, dtype=float)
        ok = ids != i
        order = np.lexsort((ids[ok], -np.round(s[ok], 12)))[:k]
        out[i] = list(zip(ids[ok][order].tolist(), s[ok][order].tolist(), strict=True))
    return out


def test_neighbours(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, "embeddings").collect()]
    want = brute_neighbours(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = collections.defaultdict(list)
    for r in sorted(QUERIES["op1_multiprobe_neighbours"](spark, SF).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    vectors = dict(rows)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, v in got.items():
        assert [s for _, s in v] == sorted((s for _, s in v), reverse=True)
        for i, s in v:
            assert abs(s - np.dot(np.array(vectors[q], float), np.array(vectors[i], float))) < 1e-12


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    same = [(100 + i, [1.0, 2.0]) for i in range(60)]
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (9, [3.0, -1.0]), (9, [3.0, -1.0]), *same]
    df = spark.createDataFrame([(i, v, 1, "q", 0) for i, v in rows], "vec_id long, embedding array<double>, rank int, bucket string, copy int")
    got = collections.defaultdict(list)
    for r in sorted(ann.search(df, F.col("vec_id") % 20 == 0, 20, recall=1.0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    use = [r for r in dict((i, (i, v)) for i, v in rows if i is not None).values() if r[1] and len(r[1]) == 2 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    want = brute_neighbours(use, [r for r in use if r[0] % 20 == 0], 20)
    assert dict(got) == want
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.filter("vec_id in (0, 9)"), F.col("vec_id") % 20 == 0).select("query_id", "vec_id", "score").collect() == [(0, 9, 3.0)]


def test_probes_come_in_order_of_estimated_success():
    rng = np.random.default_rng(0)
    index = ann.Index(np.zeros((1, 4, 2)), np.zeros((1, 4)), 1.0, 1.0, 1)
    for _ in range(20):
        place = rng.normal(size=4) * 3
        cell = np.floor(place)

        def cost(c):
            return sum(0.0 if d == 0 else (p - b) ** 2 if d < 0 else (1 - p + b) ** 2 for p, b, d in zip(place, cell, c - cell, strict=True))

        seen = [tuple(c) for c in index.visit(place, 81)]
        assert len(set(seen)) == 81
        costs = [cost(np.array(c)) for c in seen]
        assert all(a <= b + 1e-12 for a, b in zip(costs, costs[1:], strict=False))


def test_toxicity(spark):
    rows = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("held_out", "score", "predicted", "toxic").collect()
    held = [r for r in rows if r["held_out"]]
    good, bad = [r["score"] for r in held if r["toxic"]], [r["score"] for r in held if not r["toxic"]]
    auc = np.mean([[g > b for b in bad] for g in good])
    assert auc > 0.97
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_machine_learns_a_pair_that_single_weights_miss():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(1500)]
    y = np.array([float((0 in r) == (1 in r)) for r in rows])
    m = toxicity.fit_rows(y, rows, {i: i for i in range(6)}, steps=600)
    p = m.score([set(r.tolist()) for r in rows])
    assert np.mean((p >= 0.5) == y) > 0.97
    z = m.bias + np.array([m.w[r].sum() for r in rows])
    brute = z + np.array([sum(m.v[i] @ m.v[j] for i in r for j in r if i < j) for r in rows])
    assert np.allclose(1 / (1 + np.exp(-brute)), p)


def test_toxicity_odd(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(5, 0, 1), (5, 0, None), (6, 1, 0), (4, 1, 0), (None, 1, 1), (7, 0, 1), (8, 0, 0), (10, None, 1), (11, 1, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.filter("toxic = 0"), labels.limit(0)):
        rows = toxicity.score(docs, l).collect()
        assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    kept = toxicity.reject(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 12
    assert toxicity.score(no_docs(spark), labels).count() == 0 and toxicity.reject(no_docs(spark), labels).count() == 0


def brute_near(docs, words):
    def of(text):
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        return frozenset(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    sets = {i: of(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1:]:
            x, y = sets[i], sets[j]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 80 * (len(x) + len(y) - n):
                    p, q = sorted((root(i), root(j)))
                    parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    docs = table(spark, "documents")
    want = brute_near([(r["doc_id"], r["text"]) for r in docs.collect()], words)
    rows = (QUERIES["op3_near_duplicates"](spark, SF) if words == 2 else nearjoin.near_duplicates(docs, words)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_in_a_large_group_of_unequal_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    docs = []
    for i in range(260):
        w = list(base)
        for k in rng.sample(range(80), rng.randint(0, 9)):
            w[k] = f"x{rng.randint(0, 10**6)}"
        docs.append((i * 3 + 1, " ".join(w)))
    docs += [(5000 + i, " ".join(f"u{rng.randint(0, 30)}" for _ in range(rng.randint(1, 12)))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_near(docs, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_duplicates(df, 2).collect()}
    assert got == want


def test_near_duplicates_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "TASK_SHINGLES", 400)
    monkeypatch.setattr(nearjoin, "CHUNK", 16)
    rng = random.Random(6)
    docs = []
    for i in range(60):
        w = [f"b{k}" for k in range(40)]
        for k in rng.sample(range(40), rng.randint(0, 3)):
            w[k] = f"x{rng.randint(0, 10**6)}"
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()}
    assert got == brute_near(docs, 2)


def test_near_duplicates_odd(spark):
    rows = nearjoin.near_duplicates(odd_docs(spark), 2).collect()
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows)
    assert got[(1, 0, 1, True)] == got[(2, 0, 2, True)] == got[(3, 0, 3, True)] == got[(4, 1, 4, True)] == got[(10, 1, 10, True)] == 1
    assert got[(5, 4, 5, True)] == got[(6, 4, 5, False)] == 1 and got[(8, 7, 8, True)] == 2
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, False)]
    kept = nearjoin.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted("1 2 3 4 5 7 8 None 10 11".split())
    assert nearjoin.near_duplicates(no_docs(spark)).count() == 0 and nearjoin.keep_one(no_docs(spark)).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(df).collect()}
    assert got == {i: root(i) for i in parent if any(a != b and i in (a, b) for a, b in edges)}
    assert common.components(df.limit(0)).count() == 0


def duck(sql, **tables):
    con = duckdb.connect()
    for name, arrow in tables.items():
        con.register(name, arrow)
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def same(spark_df, found):
    columns, rows = found
    assert sorted(spark_df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, spark_df.select(*columns).collect()))) == sorted(map(repr, rows))


def test_url_rules(spark):
    urls = ["http://Example.com/en/x?y#z", "https://www.example.com/en/", "http://a.www.example.com/en/q", "ftp://notexample.com/en/", "http://x.net/es/1", "net/es/", "http://net/fr/", "http://net/FR/", None, "", "://", "x://com",
            "http://com/", "http://a.b.com?q=/en/", "http://casino.org/", "http://my-Casino.org/PoKer", "http://u.net/es", "http://example.com:80/en/", "http://éxample.com/en/\n/x", "http://q.example.com/en/casino"]
    pages = spark.createDataFrame([(i % 17, u, "h", 1, "r", "v") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, html string, rule int, verdict string, host string")
    arrow = pages.select("page_id", "url").toArrow()
    same(urlrules.judge(pages), duck(urlrules.oracle(), pages=arrow))
    assert urlrules.judge(pages.limit(0)).count() == 0
    assert [r["verdict"] for r in urlrules.judge(pages.filter("url like '%my-Casino%'")).collect()] == ["block"]
    many = [urlrules.Rule("block", f"d{i}.org/p{i}/") for i in range(300)]
    assert urlrules.judge(spark.createDataFrame([(1, "http://www.d7.org/p7/x"), (2, "http://d7.org/p8/")], "page_id long, url string"), many).orderBy("page_id").select("rule").collect() == [("d7.org/p7/",), (None,)]


def test_perspectives(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", ""), (1, 3, "cy", "héllo\U0001f600"), (2, None, None, "x"), (None, 5, "ann", "y"), (3, 1, "system", "alone"), (1, 2, "bob", None)]
    rows += [(9, i, f"s{i % 3}", "t" * (i % 7)) for i in range(700)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, start int, perspective string")
    out = perspectives.rotate(df)
    same(out, duck(ORACLES["op8_perspectives"], conversations=df.select("conv_id", "turn", "role", "text").toArrow()))
    ann_view = [r for r in out.collect() if r["conv_id"] == 1 and r["perspective"] == "ann"]
    text = "".join(r["segment"] for r in sorted(ann_view, key=lambda r: r["start"]))
    assert text.startswith("<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n")
    assert [text[r["mask_start"]:r["mask_end"]] for r in ann_view if r["mask_start"] < r["mask_end"]] == ["hi<|im_end|>"]
    assert perspectives.rotate(df.limit(0)).count() == 0


def test_pipeline(spark):
    docs = table(spark, "documents")
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        before = now
        now = common.cut(stage(spark, before, SF))
        assert now.columns == docs.columns
        if name == "near_dedup":
            want = brute_near([(r["doc_id"], r["text"]) for r in before.collect()], 5)
            assert sorted(r["doc_id"] for r in now.select("doc_id").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
        if name == "secrets":
            assert now.count() == before.count()
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()}
    assert {r[0] for r in got} == {r["doc_id"] for r in now.select("doc_id").collect()}
    assert got == {tuple(r) for r in corpus_pipeline.STAGES[3][1](spark, now, SF).select("doc_id", "piece", "length", "ids_crc32").collect()}


def test_pipeline_stages_take_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


def test_toxicity_learns_a_pair_through_score(spark):
    """The label is that exactly one of two words is there: neither word tells anything by itself."""
    rng = random.Random(11)
    common = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    docs, labels = [], []
    for i in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(common, 8) + ["zor"] * a + ["quib"] * b
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(a != b)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9


@pytest.mark.parametrize("order", [0, 1])
def test_near_duplicates_of_an_id_with_two_texts(spark, order):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, b + " more"), (2, b + " more"), (3, None)]
    df = spark.createDataFrame(rows if order == 0 else rows[::-1], "doc_id long, text string").coalesce(1)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nearjoin.near_duplicates(df, 2).collect()), key=str)
    assert got == [(1, 39, 1), (1, 39, 1), (2, 40, 1), (2, 40, 1), (3, 0, 3)]
    kept = nearjoin.keep_one(df, 2).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, a), (1, b), (3, None)], key=str)


def test_pairs_at_exactly_the_limit_in_large_nodes(spark, monkeypatch):
    """No node is small enough to be compared before the full depth: the recall of large nodes."""
    monkeypatch.setattr(nearjoin, "SMALL", 1)
    rng = random.Random(8)
    docs, want = [], 0
    for i in range(400):
        words = [f"{i}x{rng.randrange(10**9)}" for _ in range(90)]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[10:] + [f"{i}y{k}" for k in range(10)]))]
        want += 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = nearjoin.near_duplicates(df, 1).filter("component_id <> doc_id")
    assert got.filter("doc_id % 2 = 0").count() == 0 and got.count() >= 0.99 * want
    signed = nearjoin.signed_sets(df, 1).selectExpr("doc_id as cid", "doc_id as label", "tokens", "bits_a", "bits_b")
    links = {(r["a"], r["b"]) for r in nearjoin.candidate_links(signed, small=1).collect()}
    assert len({p for p in links if p[0] // 2 == p[1] // 2}) >= 0.985 * want


def test_one_hot_group_costs_no_pairs(spark, monkeypatch):
    """A large group of near copies and documents around it: right components, and few rows of the group in the trees."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(base[:k] + [f"e{i}"] + base[k + 1:])) for i, k in ((i, rng.randrange(60)) for i in range(1500))]
    docs += [(2000 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(50))) for i in range(300)]
    docs += [(5000 + i, t + " tail") for i, t in docs[1500:1550]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(nearjoin, "TASK_SHINGLES", 20_000)
    made = []
    real = nearjoin.candidate_links
    monkeypatch.setattr(nearjoin, "candidate_links", lambda c, trees: made.append(c.groupBy("label").count().agg(F.max("count")).first()[0]) or real(c, trees))
    rows = {r["doc_id"]: r["component_id"] for r in nearjoin.near_duplicates(df, 1).collect()}
    assert all(rows[i] == 0 for i in range(1500)) and all(rows[7000 + i] == 2000 + i for i in range(50)) and sum(i == c for i, c in rows.items()) == 301
    assert made[0] >= 1400


def test_a_node_that_is_cheap_to_compare_goes_no_deeper(spark, monkeypatch):
    """Its rows were written once a level more in every tree; on a table with one large group they were 12 times those of a table without."""
    rows = [(i, 0 if i < 380 else i, [7] * 128, 5 if i < 390 else -1, 3) for i in range(400)]
    df = spark.createDataFrame(rows, "cid long, label long, tokens array<int>, bits_a long, bits_b long")
    levels = []
    monkeypatch.setattr(nearjoin, "cut", lambda x, cut=nearjoin.cut: levels.append("bits_a" in x.columns and "node" in x.columns) or cut(x))
    links = {(r["a"], r["b"]) for r in nearjoin.candidate_links(df, trees=2).collect()}
    assert sum(levels) == 1
    joined = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert joined == {0: 0, **{i: 0 for i in range(380, 390)}, **{i: 390 for i in range(390, 400)}}
