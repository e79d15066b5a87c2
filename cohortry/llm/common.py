"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

SLICE_CHARS = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text only (a null text is empty), so other columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(frame: pd.DataFrame, column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pd.DataFrame]:
    """Cut a batch into runs of rows of about `chars` characters, so that working memory does not follow the batch."""
    if not len(frame):
        return
    start, held = 0, 0
    sizes = frame[column].str.len().to_numpy()
    for i, n in enumerate(sizes):
        if held and held + n > chars:
            yield frame.iloc[start:i]
            start, held = i, 0
        held += n
    yield frame.iloc[start:]


def spaced(text: str, chars: int = SLICE_CHARS) -> Iterator[str]:
    """A text in pieces cut at single spaces (not beside a space or space mark): a very long one is worked on in bounded memory."""
    at = 0
    while len(text) - at > chars and (m := _LONE_SPACE.search(text, at + chars)):
        yield text[at:m.start()]
        at = m.end()
    yield text[at:]


_HELD: dict[tuple, object] = {}


def held_table(key: tuple, make: Callable[[], object]):
    """What a worker process remembers from task to task. Workers serve one stage after another: the table of another operator goes when a new one is made."""
    if key not in _HELD:
        forget_tables()
        _HELD[key] = make()
    return _HELD[key]


def forget_tables() -> None:
    """Give back what an earlier stage left in this worker process."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


_LONE_SPACE = re.compile("(?<![ \u2581]) (?![ \u2581])")


class WordTable(dict):
    """word -> value, learnt once and for many words in one call. Values in excess of `room` are forgotten by `settle` (after each slice of texts), the first ones
    stay; after `turns` times `room` forgotten ones the table starts anew, for texts that have changed. Look words up only after `hold`."""

    def __init__(self, learn: Callable[[list[str]], Iterable], room: int, turns: int = 10):
        super().__init__()
        self.learn, self.room, self.turns, self.extra, self.passed = learn, room, turns, [], 0

    def hold(self, words: set) -> None:
        if new := [w for w in words if w not in self]:
            self.update(zip(new, self.learn(new), strict=True))
            self.extra += new[max(0, len(new) - max(0, len(self) - self.room)):] if len(self) > self.room else []

    def settle(self) -> None:
        for w in self.extra:
            self.pop(w, None)
        self.passed += len(self.extra)
        self.extra = []
        if self.passed > self.turns * self.room:
            self.clear()
            self.passed = 0


def split_all(texts: Iterable[str], split: Callable[[str], list[str]], table: WordTable) -> Iterator[list[list[str]]]:
    """Words of each text, as lists for the pieces of a very long one, with all of them held in the table: in one call for a slice of texts."""
    held: list[list[list[str]]] = []
    for text in texts:
        if len(text) <= SLICE_CHARS:
            held.append([split(text)])
            continue
        table.hold({w for parts in held for words in parts for w in words})
        yield from held
        held = []
        parts = []
        for some in spaced(text):
            words = split(some)
            table.hold(set(words))
            parts.append(words)
        yield parts
    table.hold(set().union(*(words for parts in held for words in parts)))
    yield from held


def by_key(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys from a partition that is sorted by them; a run may span batches."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        change = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        change[0] = True
        starts = [*change.nonzero()[0].tolist(), len(frame)]
        values = list(zip(*(frame[k].tolist() for k in keys), strict=True))
        for a, b in zip(starts, starts[1:], strict=False):
            if last is not None and values[a] != last:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held.append(frame.iloc[a:b])
            last = values[a]
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


#: Edges that one task of a round of `components` holds.
EDGES = 100_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node that has an edge; component is the smallest
    node reachable. Alternating large-star and small-star passes; each pass is a min per node and one join, so the hub
    of a very large component is aggregated before the shuffle and split by the skew join. State is checkpointed. The number of tasks of a round follows
    the number of edges, so that few edges do not leave hundreds of tiny shuffle files a round."""
    def one_way(e: DataFrame) -> DataFrame:
        return e.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(one_way(edges))
    seen = digest(now)
    for _ in range(rounds):
        k = -(-seen[0] // EDGES) or 1
        now = now.coalesce(k)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = one_way(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(k)).coalesce(k)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        now = cut(one_way(large.join(low, "a").select("b", "m").union(low.select("a", "m")).toDF("a", "b").coalesce(k)).coalesce(k))
        new = digest(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select("b", "b").distinct().toDF("node", "component"))
