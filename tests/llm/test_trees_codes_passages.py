"""Prefix trie, vector codes and passage quality against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import SF, no_docs, odd_docs
from pyspark.sql import functions as F

from cohortry.llm import passages, trie, vectorcodes
from cohortry.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt_by_hand(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def trie_by_hand(rows):
    convs = rebuilt_by_hand(rows)
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    out = []
    for k, some in members.items():
        below = [x for x in members if x[:len(k)] == k]
        ends = ",".join(str(c) for c in sorted(c for c in some if len(convs[c]) == len(k)))
        out.append((min(some), len(k), min(members[k[:-1]]) if k else None, len(some), kids[k], sum(kids[x] == 0 for x in below),
                    sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made_turns(seed):
    rng = random.Random(seed)
    texts = ["hello", "wörld \U0001f600", "", "a b c", None]
    rows = []
    for c in [*range(-3, 40), *range(98, 140), 300, 301, 302, 1000]:
        for _ in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([None, 0, 1, 1, 2, 3]), rng.choice(["user", "bot", None]), rng.choice(texts)))
    rows += [(200, t, "user", f"t{t % 7}") for t in range(90)]  # one long chain, its prefixes as conversations of their own
    rows += [(200 + k, t, "user", f"t{t % 7}") for k in (1, 2, 3, 4) for t in range(20 * k)]
    return rows + [(None, 1, "user", "lost"), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 4)])
def test_trie_equals_brute_force(spark, seed, block):
    rows = made_turns(seed)
    turns = spark.createDataFrame(rows, TURNS).repartition(5).withColumns({"depth": F.lit("x"), "conv": F.lit(0), "k1": F.lit(1), "_part": F.lit(2)})
    got = sorted(map(tuple, trie.trie(turns, block).collect()), key=str)
    assert got == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


def test_tree_sums_on_nested_prefixes(spark):
    """A path in which every node ends a conversation of its own, and a star: the two extremes of rake and compress."""
    n = 130
    path = [(d, d, d - 1 if d else None, int(d < n - 1), d) for d in range(n)]
    nodes = spark.createDataFrame(path, "conv long, depth long, up_conv long, n_children long, v long")
    got = {r["depth"]: r["v"] for r in trie.subtree_sums(nodes, ["v"]).collect()}
    assert got == {d: sum(range(d, n)) for d in range(n)}
    star = [(0, 0, None, 50, 1), *[(k, 1, 0, 0, k) for k in range(50)]]
    got = {(r["conv"], r["depth"]): r["v"] for r in trie.subtree_sums(spark.createDataFrame(star, nodes.schema), ["v"]).collect()}
    assert got == {(0, 0): 1 + sum(range(50)), **{(k, 1): k for k in range(50)}}


def test_the_work_of_a_trie_does_not_follow_its_depth(spark, monkeypatch):
    """Subtree totals took two checkpoints a round, and rounds followed depth and shape: the driver held a plan for each."""
    made = []
    monkeypatch.setattr(trie, "cut", lambda df, cut=trie.cut: made.append(1) or cut(df))
    counts = []
    for n in (2, 200):
        made.clear()
        rows = [(c, t, "user", f"t{t}" if t % (c + 2) else f"{c} {t}") for c in range(7) for t in range(n + c)]
        got = sorted(map(tuple, trie.trie(spark.createDataFrame(rows, TURNS)).collect()), key=str)
        counts.append(len(made))
        if n == 2:
            assert got == trie_by_hand(rows)
    assert counts[0] == counts[1]


def test_hilbert_curve_visits_neighbours():
    for dims, side in ((2, 16), (3, 8), (4, 4)):
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = vectorcodes.hilbert_keys(cells)
        assert len(set(keys.tolist())) == len(cells)
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(np.float64(np.float32(v)) * 256)) for v in r[1]] for r in rows]
    width = -(-len(x[0]) // parts)
    x = np.array([v + [0] * (parts * width - len(v)) for v in x], dtype=object).reshape(len(x), parts, width)
    books = [[list(v[p]) for v in x[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for v in x:
                groups[nearest(v[p], p)[1]].append(v[p])
            new = [[sum(c) // len(c) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
            books[p] = new
    found = [[nearest(v[p], p) for p in range(parts)] for v in x]
    errors = [sum(f[0] for f in some) for some in found]
    by = collections.Counter()
    for r, e in zip(rows, errors, strict=True):
        by[r[2]] += e
    h = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{f[1]:02x}" for f in some), e, by[r[2]], h) for r, some, e in zip(rows, found, errors, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("n", "length"), [(300, 64), (40, 37), (1, 16)])
def test_vector_codes_equal_brute_force(spark, n, length):
    rng = np.random.default_rng(n)
    centres = rng.normal(0, 1, (5, length))
    rows = [(i * 3 % n, [float(v) for v in np.float32(centres[i % 5] + rng.normal(0, 0.1, length))], None if i % 7 == 0 else i % 3) for i in range(n)]
    rows += [(rows[0][0], rows[0][1], 9), (None, rows[-1][1], 1)]
    bad = [(1001, None, 1), (1002, [None] * length, 1), (1003, [float("nan")] * length, 1), (1004, [float("inf")] * length, 1)]
    odd = [(1005, [1.0] * (length + 1), 1), (1006, [1e30] * length, 1), (1007, [], 1)]
    table = spark.createDataFrame(rows + bad + odd, VECTORS).repartition(4).withColumns({"code": F.lit("x"), "ids": F.lit(1), "ok": F.lit(2), "n": F.lit(3)})
    got = [tuple(r) for r in vectorcodes.encode(table).collect()]
    whole = sorted((r for r in got if r[1] is not None), key=str)
    assert whole == sorted(codes_by_hand(rows), key=str)
    assert sorted(r[0] for r in got if r[1] is None) == [1005, 1006, 1007]


def test_vector_codes_of_nothing(spark):
    assert vectorcodes.encode(spark.createDataFrame([], VECTORS)).count() == 0
    assert vectorcodes.encode(spark.createDataFrame([(1, None, 2)], VECTORS)).count() == 0


def test_blocks_shortlist_keeps_the_winner():
    rng = np.random.default_rng(4)
    points = (rng.integers(-300, 300, (20, 4))[rng.integers(0, 20, 2000)] + rng.integers(-20, 20, (2000, 4))).astype(np.int32)
    blocks = vectorcodes.Blocks(points)
    book = np.concatenate([rng.integers(-300, 300, (63, 4)), points[:1]]).astype(np.int64)
    far = ((points[:, None].astype(np.int64) - book[None]) ** 2).sum(axis=2)
    code, error = blocks.coded(book)
    assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
    counts, sums = blocks.gathered(book)
    assert (counts == np.bincount(code, minlength=64)).all() and (sums[code[0]] == points[code == code[0]].sum(axis=0)).all()
    assert blocks.shortlists(book).mean() < 0.5


def test_attention_gradients():
    rng = np.random.default_rng(5)
    n, y = np.array([1, 3, 2, 4]), np.array([0.0, 1, 1, 0])
    x = rng.normal(0, 1, (10, passages.WIDTH))
    p = {"W": rng.normal(0, 0.1, (passages.WIDTH, 5)), "b": rng.normal(0, 0.1, 5), "V": rng.normal(0, 1, (5, 3)), "U": rng.normal(0, 1, (5, 3)),
         "w": rng.normal(0, 1, 3), "c": rng.normal(0, 1, 5), "d": np.array(0.3)}
    _, grads = passages.gradients(p, x, n, y, 1e-3)
    for name in p:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in p[name].shape)
            ends = []
            for step in (1e-5, -1e-5):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += step
                ends.append(passages.gradients(q, x, n, y, 1e-3)[0])
            assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_quality_on_held_out_documents(spark):
    folder = SF.replace("0.001", "0.01")
    rows = QUERIES["op13_passage_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert len(rows) > 50


def test_one_bad_passage_decides_and_gets_the_attention(spark):
    """Ten passages a document; bad documents hold one odd passage. The label says only which document."""
    rng = random.Random(3)
    words = "stone river cloud lantern meadow copper harbour thistle walnut ember".split()

    def document(bad):
        parts = [" ".join(rng.choice(words) for _ in range(passages.PASSAGE)) for _ in range(10)]
        if bad:
            parts[rng.randrange(10)] = " ".join(rng.choice(words) + "%%" for _ in range(passages.PASSAGE))
        return " ".join(parts)

    docs = spark.createDataFrame([(i, document(i % 2)) for i in range(500)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(1 - doc_id % 2 as int) as quality")
    got = passages.score(docs, labels).filter("held_out").collect()
    assert len(got) > 60 and all(r["predicted"] == 1 - r["doc_id"] % 2 for r in got)
    model = passages.fit(docs, labels)
    hits = 0
    for r in docs.filter("doc_id % 2 = 1").limit(40).collect():
        x = passages.Measures().of([r["text"]])[0]
        worst = r["text"].split()[::passages.PASSAGE]
        hits += model.codes(x)[1].argmax() == next(i for i, w in enumerate(worst) if w.endswith("%%"))
    assert hits >= 30


def test_passages_of_odd_rows_and_long_texts(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 1), (8, 1), (8, 0), (10, 0), (None, 1), (11, None)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    rows = passages.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert passages.score(no_docs(spark), labels).count() == 0
    assert {r["score"] for r in passages.score(docs, labels.limit(0)).collect()} == {0.5}
    model = passages.fit(docs, labels)
    text = " ".join(f"Word{i % 500}, tail" for i in range(400_000))
    pieces = model.scores([text, "a short one"], passages.Measures())
    assert pieces[1] == pytest.approx(model.scores(["a short one"], passages.Measures())[0])
    assert pieces[0] == pytest.approx(model.scores([text[:3000]], passages.Measures())[0], abs=0.2)
