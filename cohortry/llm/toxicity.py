"""Toxicity score: a factorization machine over hashed terms.

score(x) = sigmoid(b + sum_j w_j x_j + sum_{i<j} <v_i, v_j> x_i x_j), x_j = 1 if the text holds term j. Terms are lower-case words and their first four,
five and six letters, hashed to 2^40 places, and each place once more for a second and for a third distinct word there; the machine keeps the places whose
presence differs most between the labels (likelihood ratio), and of the commonest places those whose pairs tell more than both places by themselves.
"""

from __future__ import annotations

import collections
import itertools
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, forget_tables, id_text, slices

#: Labelled rows at most that the fit reads; terms that the machine keeps; dimension of the interaction vectors.
SAMPLE, TERMS, RANK = 20_000, 4096, 4
#: Likelihood ratio (chi-square, one degree of freedom) from which a term is kept: weaker terms would fit the sample by chance.
LEAST_RATIO = 6.0
#: Commonest places (by the variance of their presence) whose pairs are counted; gain of a pair over its two places from which both are kept; pairs at most.
PAIR_TERMS, LEAST_GAIN, PAIRS = 1024, 30.0, 512
CACHED_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_PLACES = (1 << 40) - 1
_TWICE, _THRICE = 1 << 40, 1 << 41


def word_terms(word: str) -> tuple[int, ...]:
    """Hashed places of a word: the whole word, and each prefix of four to six letters that is shorter than it."""
    return tuple(xxhash.xxh3_64_intdigest(f"{k}:{word[:k]}" if k else word) & _PLACES for k in (0, 4, 5, 6) if k == 0 or len(word) > k)


class Terms:
    """Words of a text -> kept places. Words are looked up once and remembered in a bounded table."""

    def __init__(self, kept: dict[int, int] | None):
        self.kept = kept
        self.known = WordTable(self._learn, CACHED_WORDS)

    def _learn(self, new: list[str]) -> list[tuple[int, ...]]:
        kept = self.kept
        if kept is None:
            return list(map(word_terms, new))
        return [tuple([t for t in word_terms(w) if t in kept or t ^ _TWICE in kept or t ^ _THRICE in kept]) for w in new]

    def of(self, text: str) -> set[int]:
        return self.of_all([text])[0]

    def of_all(self, texts: Iterable[str]) -> list[set[int]]:
        words = [set(_WORD.findall(t.lower())) for t in texts]
        self.known.hold(set().union(*words))
        look, out = self.known.__getitem__, []
        for some in words:
            times = collections.Counter(itertools.chain.from_iterable(filter(None, map(look, some))))
            if self.kept is None:
                out.append(set(times).union([t ^ _TWICE for t, n in times.items() if n > 1], [t ^ _THRICE for t, n in times.items() if n > 2]))
            else:
                out.append({i for t, n in times.items() for i in (self.kept.get(t), self.kept.get(t ^ _TWICE) if n > 1 else None, self.kept.get(t ^ _THRICE) if n > 2 else None) if i is not None})
        self.known.settle()
        return out


@dataclass
class Machine:
    """Bias, places (hash -> row), weights and interaction vectors; a few hundred KB whatever the corpus."""

    bias: float
    places: dict[int, int]
    w: np.ndarray
    v: np.ndarray

    def score(self, rows: list[set[int]]) -> np.ndarray:
        """Probability per set of kept rows."""
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        index = np.fromiter((j for r in rows for j in sorted(r)), dtype=np.int64, count=len(at))
        return 1 / (1 + np.exp(-np.clip(raw(self.bias, self.w, self.v, at, index, len(rows))[0], -500, 500)))


def raw(bias: float, w: np.ndarray, v: np.ndarray, at: np.ndarray, index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(raw scores, sums of the vectors per row) for the nonzero entries (row `at`, column `index`)."""
    z = bias + np.bincount(at, w[index], n)
    sums = np.empty((n, v.shape[1]))
    for f in range(v.shape[1]):
        x = v[index, f]
        sums[:, f] = np.bincount(at, x, n)
        z = z + 0.5 * (sums[:, f] ** 2 - np.bincount(at, x * x, n))
    return z, sums


def fit_rows(y: np.ndarray, rows: list[np.ndarray], places: dict[int, int], rank: int = RANK, steps: int = 400, rate: float = 0.03, l2: float = 5e-5) -> Machine:
    """Full-batch Adam on the mean logistic loss, labels weighted to equal halves up to a factor of four."""
    n, m = len(y), max(1, len(places))
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    index = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, dtype=np.int64)
    rng = np.random.default_rng(7)
    bias, w, v = 0.0, np.zeros(m), rng.normal(0, 0.01, (m, rank))
    weight = np.where(y == 1, min(4.0, max(0.25, (n - y.sum()) / max(1, y.sum()))), 1.0)
    weight /= weight.sum()
    first, second = [0.0, np.zeros(m), np.zeros((m, rank))], [0.0, np.zeros(m), np.zeros((m, rank))]
    for step in range(1, steps + 1):
        z, sums = raw(bias, w, v, at, index, n)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        each = g[at]
        gv = np.empty_like(v)
        own = np.bincount(index, each, m)
        for f in range(rank):
            gv[:, f] = np.bincount(index, each * sums[at, f], m) - v[:, f] * own
        grads = [g.sum(), own + l2 * w, gv + 10 * l2 * v]
        values = [bias, w, v]
        for k in range(3):
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.97 * second[k] + 0.03 * grads[k] ** 2
            values[k] = values[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.97**step)) + 1e-9)
        bias, w, v = values
    return Machine(float(bias), places, w, v)


def pair_terms(y: np.ndarray, rows: list[np.ndarray], common: np.ndarray, least: float = LEAST_GAIN, most: int = PAIRS) -> list[int]:
    """Of the columns `common`, those in pairs that tell the label beyond the columns alone: the likelihood ratio of the label by the four cells of a pair, less those
    by each column, is over `least` (the `most` best pairs). Counts of pairs are (columns x columns), whatever the rows."""
    k, at = len(common), {int(c): i for i, c in enumerate(common)}
    both = np.zeros((2, k, k))
    for start in range(0, len(rows), 2000):
        x = np.zeros((min(2000, len(rows) - start), k), dtype=np.float32)
        for i, row in enumerate(rows[start:start + 2000]):
            x[i, [at[c] for c in row.tolist() if c in at]] = 1
        for label in (0, 1):
            some = x[y[start:start + 2000] == label]
            both[label] += some.T @ some
    total = np.array([(y == 0).sum(), (y == 1).sum()], dtype=float)

    def information(*cells: np.ndarray) -> np.ndarray:
        """Likelihood ratio of the label by cells (label, ...)."""
        entropy = lambda n: n * np.log(np.maximum(n, 1))
        return 2 * (sum(entropy(c).sum(axis=0) - entropy(c.sum(axis=0)) for c in cells) - entropy(total).sum() + entropy(total.sum()))

    own = np.stack([np.diagonal(b) for b in both])
    alone = information(own, total[:, None] - own)
    found = []
    for a in range(k):
        joint = both[:, a]
        gain = information(joint, own[:, a, None] - joint, own - joint, total[:, None] - own - own[:, a, None] + joint) - alone[a] - alone
        found += [(-gain[b], a, int(b)) for b in np.flatnonzero(gain > least) if b > a]
    return sorted({int(common[i]) for _, *pair in sorted(found)[:most] for i in pair})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Machine:
    """Learn from the labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    At most `sample` labelled ids (those of the smallest hash) are read, with their whole texts; repeated labels of an id count once (toxic if any says so), null labels
    not at all. Terms are counted by Spark over the sample; the driver gets the kept terms (at most `terms`), the `PAIR_TERMS` commonest and, per sampled document, their
    row numbers; it keeps those of the commonest that are in a telling pair (`pair_terms`).
    Without both labels in the sample the machine has no term and gives the share of toxic labels (0 without labels).
    """
    spark = docs.sparkSession
    train = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    train = train.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = train.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    ids = spark.createDataFrame([(r["_id"], r["toxic"]) for r in chosen.collect()], "_id long, toxic int")
    text = id_text(docs)
    known = text.join(F.broadcast(ids), text["doc_id"] == ids["_id"]).select("toxic", "text").repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))).persist()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        finder = Terms(None)
        for frame in frames:
            seen: dict[int, list[int]] = {}
            for some in slices(frame):
                for y, places in zip(some["toxic"], finder.of_all(some["text"]), strict=True):
                    for h in places:
                        seen.setdefault(h, [0, 0])[y] += 1
            yield pd.DataFrame({"place": list(seen), "n0": [a for a, _ in seen.values()], "n1": [b for _, b in seen.values()]}, dtype="int64")

    try:
        totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n0, n1 = totals.get(0, 0), totals.get(1, 0)
        if not (n0 and n1):
            share = n1 / (n0 + n1) if n0 + n1 else 0.0
            return Machine(math.log((share + 1e-6) / (1 - share + 1e-6)), {}, np.zeros(1), np.zeros((1, RANK)))
        share, a, b = n1 / (n0 + n1), F.col("n0"), F.col("n1")

        def part(x: F.Column, expected: F.Column) -> F.Column:
            return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

        ratio = 2 * (part(b, (a + b) * share) + part(a, (a + b) * (1 - share)) + part(n1 - b, (n0 + n1 - a - b) * share) + part(n0 - a, (n0 + n1 - a - b) * (1 - share)))
        counted = known.mapInPandas(count, "place long, n0 long, n1 long").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter("n0 + n1 >= 2").persist()
        places = counted.select("place", ratio.alias("ratio")).filter(F.col("ratio") > LEAST_RATIO).orderBy(F.desc("ratio"), "place").limit(terms).collect()
        common = counted.orderBy(F.desc((a + b) * (n0 + n1 - a - b)), "place").limit(PAIR_TERMS).collect()
        counted.unpersist()
        kept = {r["place"]: i for i, r in enumerate(places)}
        single = len(kept)
        for r in common:
            kept.setdefault(r["place"], len(kept))

        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            forget_tables()
            finder = Terms(kept)
            for frame in frames:
                for some in slices(frame):
                    yield pd.DataFrame({"toxic": some["toxic"], "held": [np.array(sorted(x), dtype="<i4").tobytes() for x in finder.of_all(some["text"])]})

        data = known.mapInPandas(rows, "toxic int, held binary").orderBy(F.xxhash64("held"), "held", "toxic").collect()
    finally:
        known.unpersist()
    y, held = np.array([r["toxic"] for r in data], dtype=float), [np.frombuffer(r["held"], dtype="<i4") for r in data]
    more = [i for i in pair_terms(y, held, np.array([kept[r["place"]] for r in common])) if i >= single]
    use = np.full(len(kept), -1)
    use[:single] = np.arange(single)
    use[more] = single + np.arange(len(more))
    held = [u[u >= 0] for u in (use[h] for h in held)]
    return fit_rows(y, held, {p: int(use[i]) for p, i in kept.items() if use[i] >= 0})


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5). A null or empty text has no term and gets the score of the bias alone;
    a null doc_id is never in the training part and not held out (null remainder: false); repeated rows give repeated rows."""
    machine = fit(docs, labels, sample, terms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        finder = Terms(machine.places)
        for frame in frames:
            for some in slices(frame):
                p = machine.score(finder.of_all(some["text"]))
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64").to_numpy(), "score": p, "predicted": (p >= 0.5).astype("int32")})

    out = id_text(docs).mapInPandas(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns kept, without those that the machine finds toxic (score >= 0.5). Row-wise."""
    machine = fit(docs, labels)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_tables()
        finder = Terms(machine.places)
        for texts in batches:
            parts = [machine.score(finder.of_all(some["text"])) < 0.5 for some in slices(texts.fillna("").to_frame("text"))]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype=bool)

    return docs.filter(clean("text"))
