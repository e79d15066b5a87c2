"""Document fingerprints by consistent weighted sampling.

For a term with weight w and each of `slots` hash functions, r and c are Gamma(2, 1) and b uniform, all functions of (term, slot):
t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y e^r). The slot keeps the (term, t) of the smallest a. Two documents agree in a slot with
probability equal to their generalised Jaccard similarity sum(min(w, w')) / sum(max(w, w')).
"""

from __future__ import annotations

import collections
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import BUCKET, value_buckets
from ..session import bucket_count
from .common import WordTable, held_table, id_text, slices

SLOTS = 64
CACHED_TERMS = 200_000
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def samples(terms: np.ndarray, weights: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(ln a, 16-bit code of (term, t)) per term hash (uint64) and slot. Two hashes give the four uniforms of the Gamma draws, a third b."""
    low, scale = np.uint64(0xFFFFFF), np.float32(2.0**-24)

    def uniform(h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & low).astype(np.float32) * scale + scale / 2

    with np.errstate(over="ignore"):
        seed = _mix(terms[:, None] + _GOLD * np.arange(1, slots + 1, dtype=np.uint64)[None, :])
        first, second = _mix(seed + _GOLD), _mix(seed ^ _M2)
    r = -np.log(uniform(first, 0) * uniform(first, 32))
    ln_c = np.log(-np.log(uniform(second, 0) * uniform(second, 32)))
    b = uniform(seed, 8)
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    with np.errstate(over="ignore"):
        code = (seed + t.astype(np.int64).astype(np.uint64) * _M1) * _GOLD >> np.uint64(48)
    return ln_c - r * (t - b) - r, code.astype(np.uint16)


def sampler_of(slots: int) -> Sampler:
    """One sampler per worker process: what it has learnt serves the next task."""
    return held_table(("sampler", slots), lambda: Sampler(slots))


class Sampler:
    """Signatures with the samples of (word, count) pairs remembered: `room` pairs for good, later ones for the slice of texts at hand."""

    def __init__(self, slots: int = SLOTS, room: int = CACHED_TERMS):
        self.slots = slots
        self.a = np.empty((0, slots), dtype=np.float32)
        self.code = np.empty((0, slots), dtype=np.uint16)
        self.used = 0
        self.known = WordTable(self._learn, room)

    def _learn(self, pairs: list[tuple[str, int]]) -> range:
        first, self.used = self.used, self.used + len(pairs)
        if self.used > len(self.a):
            more = max(self.used - len(self.a), len(self.a) // 2, 4096)
            self.a = np.concatenate([self.a, np.empty((more, self.slots), dtype=np.float32)])
            self.code = np.concatenate([self.code, np.empty((more, self.slots), dtype=np.uint16)])
        for k in range(0, len(pairs), 1000):
            some = pairs[k:k + 1000]
            hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w, _ in some), dtype=np.uint64, count=len(some))
            at = slice(first + k, first + k + len(some))
            self.a[at], self.code[at] = samples(hashed, np.array([c for _, c in some], dtype=float), self.slots)
        return range(first, self.used)

    def signatures(self, texts: Iterable[str]) -> list[np.ndarray]:
        """16-bit codes, one per slot, for each text. Terms are the words between white space in lower case, weights their counts; a text without words is one
        term by itself."""
        pairs = [list((collections.Counter(t.lower().split()) or {t + "\0": 1}).items()) for t in texts]
        row = self.known.get
        rows = [np.array([row(p, -1) for p in some]) for some in pairs]
        new = [np.flatnonzero(r < 0).tolist() for r in rows]
        self.known.hold({some[i] for some, at in zip(pairs, new, strict=True) for i in at})
        for r, some, at in zip(rows, pairs, new, strict=True):
            if at:
                r[at] = [self.known[some[i]] for i in at]
        every, out = np.arange(self.slots), []
        for r in rows:
            low = np.inf
            for k in range(0, len(r), 4096):
                some = r[k:k + 4096]
                a = self.a[some]
                first = a.argmin(axis=0)
                value, own = a[first, every], self.code[some[first], every]
                code = own if k == 0 else np.where(value < low, own, code)
                low = np.minimum(low, value)
            out.append(code)
        kept = self.known[self.known.extra[0]] if self.known.extra else self.used
        self.known.settle()
        self.used = kept if self.known else 0
        return out

    def signature(self, text: str) -> np.ndarray:
        return self.signatures([text])[0]


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Estimated generalised Jaccard similarity of two signatures, corrected for chance agreement of 16-bit codes."""
    return max(0.0, (float((x == y).mean()) - 2.0**-16) / (1 - 2.0**-16))


def hexed(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, fingerprint of every whole text (null: empty). Row-wise, no shuffle; equal texts have equal fingerprints."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = sampler_of(slots)
        for frame in frames:
            for some in slices(frame):
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64").to_numpy(), "fingerprint": list(map(hexed, sampler.signatures(some["text"])))})

    return id_text(docs).mapInPandas(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of id_text placed for a walk in order of (doc_id, text): columns slot, guest, doc_id, text.

    Ids are cut into ranges by bounded quantiles; each range is one slot, and the first row of the following range (of the first range, after the last) is
    its guest, so that every row's successor is in its own slot. One shuffle of the texts; the driver holds one id per range. Null ids come first.
    """
    spark = docs.sparkSession
    ranged = value_buckets(docs, "doc_id", bucket_count(spark))
    low = ranged.groupBy(BUCKET).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("m")).orderBy(BUCKET).collect()
    slots = [(r[BUCKET], r["m"]["doc_id"]) for r in low]
    own = ranged.select(F.col(BUCKET).alias("slot"), F.lit(False).alias("guest"), "doc_id", "text")
    if not slots:
        return own
    ids = [i for _, i in slots if i is not None]
    first = ranged.filter(F.col("doc_id").isin(ids) | F.col("doc_id").isNull()) if None in [i for _, i in slots] else ranged.filter(F.col("doc_id").isin(ids))
    first = first.groupBy(BUCKET).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "text")).alias("m"))
    before = spark.createDataFrame([(b, slots[k - 1][0]) for k, (b, _) in enumerate(slots)], "b int, slot int")
    guests = first.join(F.broadcast(before), F.col(BUCKET) == F.col("b")).select("slot", F.lit(True).alias("guest"), F.col("m.doc_id").alias("doc_id"), F.col("m.text").alias("text"))
    return own.union(guests)


def compare(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document in ascending doc_id; the last
    document's next is the first, a single document's is itself. Null texts are empty. Repeated ids are ordered by text. An empty table gives no row.
    """
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = sampler_of(slots)
        held = None  # (slot, guest, doc_id, text, signature) of the row before
        for frame in frames:
            for some in slices(frame):
                rows = list(zip(some["slot"], some["guest"], some["doc_id"], some["text"], sampler.signatures(some["text"]), strict=True))
                pairs = [(x, y) for x, y in zip([held, *rows] if held else rows, rows if held else rows[1:], strict=False) if x[0] == y[0] and not x[1]]
                edited = [x[3][:len(x[3]) - len(x[3]) // 4] + y[3][:len(x[3]) // 4] for x, y in pairs]
                out = []
                for (x, y), text, e in zip(pairs, edited, sampler.signatures(edited), strict=True):
                    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((x[2], len(x[3]), digest, hexed(x[4]), hexed(e), likeness(x[4], e), likeness(x[4], y[4])))
                held = rows[-1]
                yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    walk = with_next(id_text(docs))
    return walk.repartition(bucket_count(docs.sparkSession), "slot").sortWithinPartitions("slot", "guest", "doc_id", "text").mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
