"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of `PASSAGE` words. A passage is encoded as h = tanh(W x + b) from its measurements x; gated attention weighs the passages,
a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k))), and the document's score is sigmoid(c . sum_k a_k h_k + d). All of W, V, U, w, c are learnt from document labels alone.
Measurements: shares of character classes, word forms (first and last character class), lengths, repeats inside the passage, and hashed words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_tables, id_text, slices, spaced

PASSAGE = 48
#: Labelled documents and passages that the fit reads at most; size of a passage's code and of the attention's hidden layer.
SAMPLE, SAMPLE_PASSAGES, CODE, HIDDEN = 6_000, 24_000, 32, 16
#: From this score on a document counts as good.
LEAST = 0.3
WORD_PLACES = 64
#: Words whose measurements a worker remembers.
CACHED_WORDS = 150_000
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", ";:", "!?", "'\"", "()[]{}", "|", "#&$%*", "-_/\\", "@^~+=<>`"]
_K = len(_CLASSES) + 2  # then other ASCII, then beyond ASCII
_CLASS_OF = np.full(129, _K - 2, dtype=np.int64)
for _i, _some in enumerate(_CLASSES):
    _CLASS_OF[[ord(c) for c in _some]] = _i
_CLASS_OF[128] = _K - 1
_FLAGS, _STATS = 4, 4
WIDTH = _K + _FLAGS + _STATS + _K * _K + WORD_PLACES


class Measures:
    """Measurements of passages; those of a word are remembered in a bounded table."""

    def __init__(self, room: int = CACHED_WORDS):
        self.room, self.known = room, {}
        self.dense = np.zeros((0, _K + _FLAGS), dtype=np.float32)
        self.form, self.place = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def _learn(self, words: list[str]) -> None:
        first, n = len(self.known), len(words)
        self.known.update(zip(words, range(first, first + n), strict=True))
        if first + n > len(self.form):
            more = max(first + n, 2 * len(self.form))
            self.dense = np.resize(self.dense, (more, self.dense.shape[1]))
            self.form, self.place = np.resize(self.form, more), np.resize(self.place, more)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _CLASS_OF[np.minimum(code, 128)]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(n), sizes)
        counts = np.bincount(owner * _K + kind, minlength=n * _K).reshape(n, _K)
        at, head = slice(first, first + n), kind[ends - sizes]
        self.dense[at, :_K] = counts
        self.dense[at, _K] = (counts[:, 1] > 1) & (counts[:, 0] == 0)
        self.dense[at, _K + 1] = (head == 1) & (counts[:, 1] == 1)
        self.dense[at, _K + 2] = sizes > 14
        self.dense[at, _K + 3] = sizes == 1
        self.form[at] = head * _K + kind[ends - 1]
        self.place[at] = [xxhash.xxh3_64_intdigest(w.lower()) % WORD_PLACES for w in words]

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(measurements of all passages, number of passages per text). A text without words has one passage of zeros."""
        if len(self.known) > self.room:
            self.known.clear()
        words = [t.split() for t in texts]
        known = self.known
        if new := set().union(*words).difference(known):
            self._learn(sorted(new))
        sizes = np.array([len(w) for w in words])
        row = np.fromiter((known[w] for some in words for w in some), dtype=np.int64, count=int(sizes.sum()))
        per = np.maximum(1, -(-sizes // PASSAGE))
        x = np.zeros((int(per.sum()), WIDTH), dtype=np.float32)
        if not len(row):
            return x, per
        text = np.repeat(np.arange(len(texts)), sizes)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        passage = (np.cumsum(per) - per)[text] + inside // PASSAGE
        starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        there, n = passage[starts], np.diff(np.append(starts, len(row))).astype(np.float32)
        dense = np.add.reduceat(self.dense[row], starts)
        chars = dense[:, :_K].sum(axis=1)
        pair = np.sort(passage * (len(known) + 1) + row)
        fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
        distinct = np.bincount(pair[fresh] // (len(known) + 1), minlength=len(x))[there]
        again = np.concatenate(([False], (row[1:] == row[:-1]) & (passage[1:] == passage[:-1])))
        x[there, :_K] = dense[:, :_K] / chars[:, None]
        x[there, _K:_K + _FLAGS] = dense[:, _K:] / n[:, None]
        at = _K + _FLAGS
        x[there, at] = distinct / n
        x[there, at + 1] = np.bincount(passage, again, minlength=len(x))[there] / n
        x[there, at + 2] = np.log1p(n) / 4
        x[there, at + 3] = chars / n / 10
        at += _STATS
        forms = np.bincount(passage * (_K * _K) + self.form[row], minlength=len(x) * _K * _K).reshape(len(x), -1)
        places = np.bincount(passage * WORD_PLACES + self.place[row], minlength=len(x) * WORD_PLACES).reshape(len(x), -1)
        x[there, at:at + _K * _K] = forms[there] / n[:, None]
        x[there, at + _K * _K:] = np.sqrt(places[there] / n[:, None])
        return x, per


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Attention:
    """Weights of encoder, gate and score, about 50 KB whatever the corpus; `shift` and `scale` standardise the measurements."""

    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, attention logit) per passage."""
        p = self.weights
        h = np.tanh(((x - self.shift) * self.scale) @ p["W"] + p["b"])
        return h, (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]

    def scores(self, texts: list[str], measures: Measures) -> np.ndarray:
        """Score per text. A very long text is read in pieces: the weighted sum of codes is carried from piece to piece."""
        out = np.zeros(len(texts))
        pieces = [list(spaced(t)) for t in texts]
        ends = np.cumsum([len(p) for p in pieces])
        if ends.size and ends[-1] == len(texts):
            x, n = measures.of(texts)
            h, s = self.codes(x)
            starts = np.cumsum(n) - n
            e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), n))
            z = np.add.reduceat(e[:, None] * h, starts) / np.add.reduceat(e, starts)[:, None]
            return _sigmoid(z @ self.weights["c"] + self.weights["d"])
        for i, some in enumerate(pieces):
            top, total, z = -np.inf, 0.0, np.zeros(CODE)
            for piece in some:
                h, s = self.codes(measures.of([piece])[0])
                new = max(top, s.max())
                e = np.exp(s - new)
                total, z, top = total * np.exp(top - new) + e.sum(), z * np.exp(top - new) + e @ h, new
            out[i] = _sigmoid(z / total @ self.weights["c"] + self.weights["d"])
        return out


def fit_bags(bags: list[np.ndarray], y: np.ndarray, epochs: int = 14, batch: int = 128, rate: float = 0.004, l2: float = 1e-4) -> Attention:
    """Mini-batch Adam on the mean logistic loss of the bags."""
    rng = np.random.default_rng(13)
    x = np.concatenate(bags)
    sizes = np.array([len(b) for b in bags])
    starts = np.cumsum(sizes) - sizes
    shift = x.mean(axis=0, dtype=np.float64)
    spread = np.sqrt(np.maximum(np.square(x).mean(axis=0, dtype=np.float64) - shift**2, 0))
    scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 0.02), 0.0)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    p = {"W": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, CODE)), "b": np.zeros(CODE), "V": rng.normal(0, 0.2, (CODE, HIDDEN)), "U": rng.normal(0, 0.2, (CODE, HIDDEN)),
         "w": rng.normal(0, 0.2, HIDDEN), "c": rng.normal(0, 0.1, CODE), "d": np.array(np.log(share / (1 - share)))}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        turn = rng.permutation(len(bags))
        for k in range(0, len(turn), batch):
            some = turn[k:k + batch]
            n = sizes[some]
            at = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in some])
            grads = gradients(p, (x[at] - shift) * scale, n, y[some], l2)[1]
            step += 1
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                p[name] = p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return Attention(shift, scale, p)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray, y: np.ndarray, l2: float) -> tuple[float, dict[str, np.ndarray]]:
    """(loss, its gradients) for bags of n passages each, standardised measurements x in bag order."""
    starts = np.cumsum(n) - n
    h = np.tanh(x @ p["W"] + p["b"])
    a, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    s = (a * g) @ p["w"]
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), n))
    share = e / np.repeat(np.add.reduceat(e, starts), n)
    z = np.add.reduceat(share[:, None] * h, starts)
    q = _sigmoid(z @ p["c"] + p["d"])
    loss = float(-np.mean(y * np.log(q + 1e-12) + (1 - y) * np.log(1 - q + 1e-12)) + l2 / 2 * (p["W"] ** 2).sum())
    dq = (q - y) / len(n)
    dz = np.repeat(dq[:, None] * p["c"], n, axis=0)
    da = (h * dz).sum(axis=1)
    ds = share * (da - np.repeat(np.add.reduceat(share * da, starts), n))
    gate = ds[:, None] * p["w"]
    d_a, d_g = gate * g * (1 - a * a), gate * a * g * (1 - g)
    dh = share[:, None] * dz + d_a @ p["V"].T + d_g @ p["U"].T
    pre = dh * (1 - h * h)
    return loss, {"W": x.T @ pre + l2 * p["W"], "b": pre.sum(axis=0), "V": h.T @ d_a, "U": h.T @ d_g, "w": (a * g).T @ ds, "c": z.T @ dq, "d": np.array(dq.sum())}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> Attention:
    """Learn from labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    At most `sample` labelled ids (those of the smallest hash) and `passages` passages are read; a document that would go beyond is left out of the fit, never cut.
    Repeated labels of an id count once (bad if any says so), null labels not at all; of several texts of an id the smallest is read. Spark measures the passages;
    the driver gets at most `passages` rows of numbers. Without labels every score is 0.5, with one label only its share decides.
    """
    spark = docs.sparkSession
    train = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    train = train.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("quality").cast("int")).alias("_y"))
    chosen = [(r["_id"], r["_y"]) for r in train.orderBy(F.xxhash64("_id"), "_id").limit(sample).collect()]
    ids = F.broadcast(spark.createDataFrame(chosen, "_id long, _y int"))
    text = id_text(docs)
    known = text.join(ids, text["doc_id"] == ids["_id"]).groupBy("_id", "_y").agg(F.min("text").alias("text"))

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        measures = Measures()
        for frame in frames:
            for some in slices(frame):
                rows = []
                for i, y, t in zip(some["_id"], some["_y"], some["text"], strict=True):
                    n, parts = 0, []
                    for piece in spaced(t):
                        x = measures.of([piece])[0]
                        n += len(x)
                        parts.append(x)
                        if n > passages:
                            parts = []
                    rows.append((i, y, n, b"".join(x.tobytes() for x in parts)))
                yield pd.DataFrame(rows, columns=["_id", "_y", "n", "x"])

    table = known.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "_id").mapInPandas(measured, "_id long, _y int, n long, x binary").persist()
    try:
        total, kept = 0, []
        sizes = {r["_id"]: r["n"] for r in table.select("_id", "n").collect()}
        for i, _ in chosen:
            if i in sizes and total + sizes[i] <= passages:
                kept.append((i,))
                total += sizes[i]
        rows = table.join(F.broadcast(spark.createDataFrame(kept, "_id long")), "_id").orderBy("_id").collect() if kept else []
    finally:
        table.unpersist()
    bags = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH) for r in rows]
    return fit_bags(bags or [np.zeros((1, WIDTH), dtype=np.float32)], np.array([float(r["_y"] > 0) for r in rows] or [0.5]), epochs=14 if rows else 0)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.3). Every passage of the whole text is weighed.

    A null or empty text has one passage of zeros and gets that passage's score; a null doc_id is never learnt from and not held out; repeated rows give repeated rows.
    """
    model = fit(docs, labels, sample, passages)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        measures = Measures()
        for frame in frames:
            for some in slices(frame):
                p = model.scores(some["text"].tolist(), measures)
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64").to_numpy(), "score": p, "predicted": (p >= LEAST).astype("int32")})

    out = id_text(docs).mapInPandas(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
