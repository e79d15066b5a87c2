"""Nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are lifted so that the largest inner product is the smallest Euclidean distance: x -> (x, sqrt(M^2 - |x|^2)), q -> (q, 0). A table has `hashes`
functions floor((a.x + b) / w) with Gaussian a; a bucket is their tuple. A query visits its own bucket and perturbed ones (each function one step down or up) in
order of the estimated success: the sum of squared distances to the borders crossed, smallest first. The candidates of all tables are merged and
reranked by the exact inner product.

The number of functions and of probes is fitted on a bounded sample: for each number of functions the probes are raised until the sampled queries reach the wanted
share of their true neighbours (found by brute force for that bounded set of queries), and the number with the least estimated work wins. Where vectors have
little structure that share needs most of the rows, and few large buckets are cheaper than many small ones. Every row is indexed.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Rows of the fit's sample; sampled queries at most; wanted share of true neighbours among them; rows that a bucket should hold.
SAMPLE, QUERIES, RECALL, BUCKET_ROWS = 4000, 200, 0.94, 256
TABLES = 2
#: Probes tried per query and table in the fit. Rough seconds of work per probe (its row and its results) and per compared row, for the choice of functions.
MOST_PROBES, PROBE_S, ROW_S = 2000, 45e-6, 50e-9
#: Rows of a bucket, and queries at a bucket, that one task compares; beyond it they are cut into parts.
ROWS_A_PART, QUERIES_A_PART = 16_384, 4_096


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not zero, of the most frequent length, all components finite. Repeated rows count once."""
    v = F.col(vector) if dict(vectors.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter((F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    rows = rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))
    return rows.withColumn("copy", F.concat_ws(":", F.xxhash64("v"), F.hash("v")))


@dataclass
class Index:
    a: np.ndarray  # tables x hashes x (dim + 1)
    b: np.ndarray
    w: float
    longest: float
    probes: int

    def places(self, x: np.ndarray, lift: bool) -> np.ndarray:
        """(a.x + b) / w per row, table and hash."""
        extra = np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(axis=1))) if lift else np.zeros(len(x))
        return (np.einsum("nd,thd->nth", np.column_stack([x, extra]), self.a) + self.b) / self.w

    @staticmethod
    def key(cells: np.ndarray) -> np.ndarray:
        """64-bit key of bucket tuples (last axis)."""
        h = np.zeros(cells.shape[:-1], dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(cells.shape[-1]):
                h = (h ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
        return h.view(np.int64)

    def visit(self, place: np.ndarray, probes: int) -> Iterator[np.ndarray]:
        """The bucket tuples of one table in order of estimated success (squared border distances, lazily enumerated with a heap)."""
        cell = np.floor(place).astype(np.int64)
        inside = place - cell
        moves = sorted([(float(inside[i] ** 2), i, -1) for i in range(len(cell))] + [(float((1 - inside[i]) ** 2), i, 1) for i in range(len(cell))])
        yield cell
        heap = [(moves[0][0], (0,))]
        found = 1
        while heap and found < probes:
            cost, chosen = heapq.heappop(heap)
            last = chosen[-1]
            if last + 1 < len(moves):
                heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
                heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            if len({moves[i][1] for i in chosen}) == len(chosen):
                step = cell.copy()
                for i in chosen:
                    step[moves[i][1]] += moves[i][2]
                yield step
                found += 1


def _top(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, block: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query row: (row, ids, exact scores) of its k largest products, ties to the smaller id. Products of a block pick the candidates; the scores of these are
    summed anew in one fixed order, so that a pair has the same score in every block."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    for at in range(0, len(q), block):
        s = q[at:at + block] @ x.T
        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
        for i in range(len(s)):
            near = np.flatnonzero(s[i] >= floor[i] - 1e-9 * (1 + abs(floor[i]))) if np.isfinite(floor[i]) else np.arange(s.shape[1])
            score = (q[at + i] * x[near]).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:k]
            yield at + i, ids[near][best], score[best]


def fit(rows: DataFrame, k: int, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS, recall: float = RECALL) -> Index | None:
    """Index parameters from at most `SAMPLE` rows (smallest hash of the id). None for an empty table."""
    spark = rows.sparkSession
    total = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("m")).first()
    if not total["n"]:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").collect()
    x = np.array([r["v"] for r in sample], dtype=float)
    asked = spark.sparkContext.broadcast(x[:QUERIES])

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                v = np.array(frame["v"].tolist(), dtype=float)
                ids = frame["vec_id"].to_numpy()
                at = {i: n for n, i in enumerate(ids.tolist())}
                for q, best, score in _top(asked.value, ids, v, k):
                    yield pd.DataFrame({"q": q, "vec_id": best, "score": score, "v": [v[at[i]] for i in best]})

    best = rows.select("vec_id", "v").mapInPandas(near, "q int, vec_id long, score double, v array<double>")
    best = best.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k).select("q", "vec_id", "v").collect()
    asked.destroy()
    own = {n: r["vec_id"] for n, r in enumerate(sample[:QUERIES])}
    goal: dict[int, list] = {}
    for r in best:  # the query's own row is found by any table and would flatter the share
        if r["vec_id"] != own[r["q"]]:
            goal.setdefault(r["q"], []).append(r["v"])
    longest = float(total["m"]) * (1 + 1e-12)
    chosen, least = None, math.inf
    for hashes in range(1, max(1, math.ceil(math.log(max(3.0, total["n"] / bucket_rows), 3))) + 2):
        rng = np.random.default_rng(5)
        index = Index(rng.normal(size=(tables, hashes, x.shape[1] + 1)), rng.uniform(0, 1, (tables, hashes)), 1.0, longest, 1)
        spread = 1.2 * (float(index.places(x, True).std(axis=0).mean()) or 1.0)  # about three cells of weight per function
        shift = index.b
        for _ in range(60):  # a step of one cell must reach the neighbours: wider cells until it does
            index.w, index.b = spread, shift * spread
            probes, scanned = _needed(index, x, goal, recall)
            if probes:
                break
            spread *= 2
        work = tables * probes * PROBE_S + scanned * total["n"] * ROW_S
        if chosen is None or work < least:
            index.probes, chosen, least = probes, index, work
    return chosen


def _needed(index: Index, x: np.ndarray, goal: dict[int, list], recall: float) -> tuple[int, float]:
    """(probes per table for the wanted share of the true neighbours, share of the rows then compared); (0, 1) where MOST_PROBES do not reach it."""
    tables, hashes = index.b.shape
    most = min(MOST_PROBES, 3**hashes)
    places, far = index.places(x[:QUERIES], False), most + 1
    cells = Index.key(np.floor(index.places(x, True)).astype(np.int64))
    need: list[int] = []
    shares = []
    for n, (q, vs) in enumerate(goal.items()):
        ranks = [{int(Index.key(c)): i + 1 for i, c in enumerate(index.visit(places[q, t], most))} for t in range(tables)]
        keys = Index.key(np.floor(index.places(np.array(vs), True)).astype(np.int64))
        need += np.min([[ranks[t].get(int(h), far) for h in keys[:, t]] for t in range(tables)], axis=0).tolist()
        if n < 20:
            shares.append(np.min([[ranks[t].get(int(h), far) for h in cells[:, t]] for t in range(tables)], axis=0))
    if not need:
        return 1, 1.0
    need.sort()
    probes = need[min(len(need), math.ceil(recall * len(need))) - 1]
    return (probes, float(np.mean([s <= probes for s in shares]))) if probes < far else (0, 1.0)


def _match(probes: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """Score (copy, bucket) probes against the rows of the bucket: (copy, vec_id, score), the best k of each task per query."""
    here = cells.groupBy("bucket").agg(F.ceil(F.count("*") / ROWS_A_PART).cast("int").alias("rp"))
    asked = probes.groupBy("bucket").agg(F.ceil(F.count("*") / QUERIES_A_PART).cast("int").alias("qp"))
    parts = here.join(asked, "bucket")
    data = cells.join(parts, "bucket").withColumn("r", F.pmod(F.xxhash64("vec_id"), F.col("rp"))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qp") - 1))).select(
        "bucket", F.col("r").cast("int").alias("r"), "q", "vec_id", "v")
    wanted = probes.join(parts, "bucket").withColumn("q", F.pmod(F.xxhash64("copy"), F.col("qp")).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rp") - 1)))
    wanted = wanted.select("bucket", "r", "q", "copy", F.col("qv"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"copy": pd.Series(dtype=str), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
        q, x = np.array(left["qv"].tolist(), dtype=float), np.array(right["v"].tolist(), dtype=float)
        names = left["copy"].to_numpy()
        found = list(_top(q, right["vec_id"].to_numpy(), x, k))
        return pd.DataFrame({"copy": np.repeat(names[[i for i, _, _ in found]], [len(a) for _, a, _ in found]), "vec_id": np.concatenate([a for _, a, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    keys = ["bucket", "r", "q"]
    return wanted.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(score, "copy string, vec_id long, score double")


def search(vectors: DataFrame, is_query: F.Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, nearest first, ties to the smaller id; the query's own id is no candidate.

    Exact copies are searched once: of the rows with equal vectors only the k + 1 smallest ids can be in any result, so the others are queries at most. A query
    with fewer than k results is compared with every row, in blocks, so it gets all candidates. Null, zero or non-finite vectors and those of another
    length than most take no part. `is_query` is a condition on the key column. Buckets and their queries are cut into parts of a bounded size.
    """
    rows = cut(usable(vectors, key, vector))
    # the k + 1 smallest ids of each copy group, in two steps so that a hot copy is spread first
    salted = W.partitionBy("copy", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = rows.select("copy", "vec_id").distinct().withColumn("_n", F.row_number().over(salted)).filter(F.col("_n") <= k + 1)
    few = few.withColumn("_n", F.row_number().over(W.partitionBy("copy").orderBy("vec_id"))).filter(F.col("_n") <= k + 1).select("vec_id", "copy")
    base = cut(rows.dropDuplicates(["vec_id"]).join(few, ["vec_id", "copy"]))
    kind = dict(base.dtypes)["v"]
    empty = "query_id long, rank int, vec_id long, score double"
    index = fit(base, k, tables, recall=recall)
    if index is None:
        return vectors.sparkSession.createDataFrame([], empty)
    asked = rows.withColumnRenamed("vec_id", key).filter(is_query).select(F.col(key).alias("query_id"), "copy", "v").distinct()
    queries = asked.groupBy("copy").agg(F.first("v").alias("qv"))

    def cells_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            v = np.array(frame["v"].tolist(), dtype=float)
            keys = Index.key(np.concatenate([np.broadcast_to(np.arange(tables)[None, :, None], (len(v), tables, 1)), np.floor(index.places(v, True)).astype(np.int64)], axis=2))
            for t in range(tables):
                yield pd.DataFrame({"bucket": keys[:, t], "vec_id": frame["vec_id"], "v": frame["v"]})

    def probes_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 200):
                some = frame.iloc[at:at + 200]
                places = index.places(np.array(some["qv"].tolist(), dtype=float), False)
                out_c, out_b, out_v = [], [], []
                for i, (copy, v) in enumerate(zip(some["copy"], some["qv"], strict=True)):
                    for t in range(tables):
                        seen = np.array(list(itertools.islice(index.visit(places[i, t], index.probes), index.probes)))
                        out_b.append(Index.key(np.column_stack([np.full(len(seen), t), seen])))
                        out_c += [copy] * len(seen)
                        out_v += [v] * len(seen)
                yield pd.DataFrame({"copy": out_c, "bucket": np.concatenate(out_b), "qv": out_v})

    cells = cut(base.mapInPandas(cells_of, f"bucket long, vec_id long, v {kind}"))
    probes = queries.mapInPandas(probes_of, f"copy string, bucket long, qv {kind}")
    found = cut(_match(probes, cells, k + 1))
    order = W.partitionBy("copy").orderBy(F.desc("score"), "vec_id")

    def ranked(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("copy", "vec_id").agg(F.max("score").alias("score")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)

    best = ranked(found)
    short = queries.join(best.groupBy("copy").agg(F.count("*").alias("_c")), "copy", "left").filter(F.coalesce("_c", F.lit(0)) <= k).select("copy", "qv")
    blocks = math.ceil(base.count() / ROWS_A_PART)
    every = short.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    more = _match(every, base.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("bucket"), "vec_id", "v"), k + 1)
    best = ranked(found.union(more)).drop("_n")
    pairs = asked.select("query_id", "copy").join(best, "copy").filter("query_id != vec_id")
    last = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", last).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
