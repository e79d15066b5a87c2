"""Best-fit packing of tokenised documents into sequences, by exact-complement hashing on the table of lengths.

Pieces of one length are interchangeable, so the packing is solved on the histogram of lengths (at most `cap` rows, whatever the input)
and Spark deals the pieces out by their rank within their length.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import BUCKET, bucketed_prefix
from ..session import cut
from .common import WordTable, held_table, id_text, slices, split_all

CAP = 2048
CACHED_WORDS = 300_000


class WordTokens:
    """Ids of a text by a tokenizers file, word by word. White space never joins a token, so ids of words are remembered (a bounded table)
    and only new words go through the tokenizer, many in one call."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.end = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.end[i] = token.endswith("</w>")
        self.part = regex.compile(r"\p{L}+|[^\p{L}]+")
        self.words = WordTable(self._learn, CACHED_WORDS)
        self.letters = WordTable(self._letter_runs, CACHED_WORDS)
        self.others = WordTable(self._plain, CACHED_WORDS // 10)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _letter_runs(self, runs: list[str]) -> list[bytes]:
        """Each run of lower-case letters ends in exactly one end-of-word token, which cuts the ids of a joined call apart."""
        out: list[bytes] = []
        for at in range(0, len(runs), 1000):
            some = runs[at:at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.end[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, starts = ids.tobytes(), [0, *(4 * ends).tolist()]
                out += [raw[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            else:
                out += self._plain(some)
        return out

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of new words. Letters are put together from runs of lower-case letters and what is between them; words in which that might not be exact
        (an apostrophe, a special token, characters that change with their neighbours) go through the tokenizer whole."""
        plans: list[list[str] | None] = []
        runs, others = set(), set()
        for w in new:
            low = w.lower()
            if low.isalpha() and (w.isascii() or self._steady(w, low)):
                plans.append([low])
                runs.add(low)
            elif "'" in w or "<|" in w or len(w) > 200 or not (w.isascii() or self._steady(w, low)):
                plans.append(None)
            else:
                parts = self.part.findall(low)
                plans.append(parts)
                for x in parts:
                    (runs if x.isalpha() else others).add(x)
        self.letters.hold(runs)
        self.others.hold(others)
        letters, rest = self.letters, self.others
        out = [None if p is None else letters[p[0]] if len(p) == 1 and p[0] in letters else b"".join([letters[x] if x in letters else rest[x] for x in p]) for p in plans]
        whole = iter(self._plain([w for w, p in zip(new, plans, strict=True) if p is None]))
        out = [next(whole) if x is None else x for x in out]
        letters.settle()
        rest.settle()
        return out

    @staticmethod
    def _steady(w: str, low: str) -> bool:
        """Lower-casing and normalisation go character by character here."""
        return low.isprintable() and len(low) == len(w) and "\u03a3" not in w and "\u03c2" not in low and unicodedata.is_normalized("NFC", w) and unicodedata.is_normalized("NFC", low)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        look = self.words.__getitem__
        out = [b"".join([b"".join(map(look, words)) for words in parts]) for parts in split_all(texts, lambda t: t.replace("\n", " ").replace("\t", " ").split(" "), self.words)]
        self.words.settle()
        return out


def word_tokens(path: str) -> WordTokens:
    """One table per worker process: what it has learnt serves the next task."""
    return held_table(("word tokens", path), lambda: WordTokens(path))


def token_pieces(docs: DataFrame, path: str, cap: int = CAP) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32. The ids end with one 0; only longer documents are cut."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = word_tokens(path)
        for frame in frames:
            for some in slices(frame):
                rows = []
                for doc_id, ids in zip(some["doc_id"], tokens.encode(some["text"]), strict=True):
                    ids += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * cap)):
                        raw = ids[at:at + 4 * cap]
                        rows.append((doc_id, k, at // 4, len(raw) // 4, zlib.crc32(raw)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return id_text(docs).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def exact_complement(left: np.ndarray, length: int) -> list[int] | None:
    """One to three lengths, none above `length`, that fill the gap of a piece of this length to the cap (the last index of `left`) exactly, under the available counts
    `left`, the piece itself taken out first; [] where the piece fills the cap, None where there is no such sum. Single lengths come before pairs and
    pairs before triples; of several the one with the largest length."""
    gap = len(left) - 1 - length

    def pair(total: int, most: int) -> list[int] | None:
        high = np.arange(min(total - 1, most), (total + 1) // 2 - 1, -1)
        if not len(high):
            return None
        ok = (left[high] > 0) & (left[total - high] > 0) & ((2 * high != total) | (left[high] > 1))
        k = int(ok.argmax())
        return [int(high[k]), total - int(high[k])] if ok[k] else None

    if gap == 0:
        return []
    left[length] -= 1
    try:
        if gap <= length and left[gap] > 0:
            return [gap]
        if two := pair(gap, length):
            return two
        for a in np.flatnonzero(left[:min(gap - 2, length) + 1] > 0)[::-1].tolist():
            if a * 3 < gap:
                break
            left[a] -= 1
            two = pair(gap - a, a)
            left[a] += 1
            if two:
                return [a, *two]
    finally:
        left[length] += 1
    return None


def fill(counts: dict[int, int], cap: int = CAP) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Sequences for a histogram of lengths: [(((length, how many in one sequence), ...), sequences of this kind)].

    From the longest length down, a gap is closed exactly by one, two or three lengths whose sum is the complement, found by hashing the complement
    into the lengths still available, as many times as the counts allow. What no such sum fills is placed best-fit: into the open
    sequences with the smallest gap that holds it. Every step empties a length or a kind of sequence, so the steps are bounded by `cap`.
    """
    left = np.zeros(cap + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    kinds: list[tuple[list[int], int]] = []

    def fits(need: list[int]) -> int:
        lengths, times = np.unique(need, return_counts=True)
        return int((left[lengths] // times).min())

    rest: list[tuple[int, int]] = []
    for length in range(cap, 0, -1):
        while left[length]:
            more = exact_complement(left, length)
            if more is None:
                break
            need = [length, *more]
            times = fits(need)
            for x in need:
                left[x] -= times
            kinds.append((need, times))
    rest = [(int(x), int(left[x])) for x in np.flatnonzero(left)[::-1]]
    open_by_gap: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    gaps: np.ndarray = np.zeros(cap + 1, dtype=bool)
    done = [([(x, 1) for x in need], times) for need, times in kinds]

    def put(kind: list[tuple[int, int]], times: int) -> None:
        gap = cap - sum(a * b for a, b in kind)
        if gap:
            open_by_gap.setdefault(gap, []).append((kind, times))
            gaps[gap] = True
        else:
            done.append((kind, times))

    for length, n in rest:
        while n:
            room = np.flatnonzero(gaps[length:])
            if not len(room):
                each = min(cap // length, n)
                put([(length, each)], n // each)
                n %= each
                continue
            gap = int(room[0]) + length
            kind, times = open_by_gap[gap].pop()
            gaps[gap] = bool(open_by_gap[gap])
            each = min(gap // length, n)
            use = min(times, n // each)
            n -= use * each
            if times > use:
                put(kind, times - use)
            put([*kind, (length, each)], use)
    done += [x for v in open_by_gap.values() for x in v]
    return [(tuple(kind), times) for kind, times in done]


def pack(docs: DataFrame, path: str, cap: int = CAP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single id 0. A null doc_id stays null and is a document of its own, as are repeated rows. An empty table gives no row.
    The pieces are tokenised once and checkpointed (five numbers a piece). Their ranks within a length come from hash buckets, so that
    a length that a third of all pieces share is spread over tasks. The plan's table is bounded by `cap` and small enough to broadcast.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, path, cap))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, taken, first = [], dict.fromkeys(counts, 0), 0
    for kind, times in fill(counts, cap):
        base = 0
        for length, each in kind:
            low = taken[length]
            taken[length] += times * each
            rows.append((length, low, taken[length], first, each, base))
            base += length * each
        first += times
    plan = spark.createDataFrame(rows, "_length long, _low long, _high long, _first long, _each long, _base long")
    width = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn(BUCKET, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(width)).cast("int"))
    ranked = bucketed_prefix(dealt, ["length"], ["doc_id", "piece"], {"_rank": F.lit(1).cast("long")})
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    nth = F.col("_rank") - F.col("_low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_first") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_base") + F.pmod(nth, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )
