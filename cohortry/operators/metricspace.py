"""Exact similarity joins and nearest neighbours in a metric space, without comparing all pairs.

Points are assigned to the nearest of some pivots. A cell keeps its pivot, its radius (the largest distance of a member to the pivot) and its size, so the triangle
inequality bounds every distance between two cells, or between a point and a cell, before any vector is compared:

    |p(A) - p(B)| - radius(A) - radius(B)  <=  d(a, b)  <=  |p(A) - p(B)| + radius(A) + radius(B)

Pivots come from a bounded sample (the smallest hashes of the ids); cells that hold too many points get pivots of their own from a bounded sample of the cell, and what is still
too large is cut into hash chunks that share the bound. Cells are packed into blocks; what cannot be excluded is compared in dense products, one task for a pair of blocks.
The results do not depend on the pivots.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import h60
from ..session import shared
from .ordered import hash_rank

#: Points that pivots are chosen from, pivots of the whole table, pivots of one cell that is split: whatever the table's size.
SAMPLE, PIVOTS, SPLIT = 2048, 64, 16
SLACK = 1e-7
#: Groups up to which the tables per group (pivots, cells) are broadcast.
FEW = 256
#: Blocks of a table that is compared with itself (their pairs are the tasks), the most rows of one, and the rows of one dense product inside a task.
BLOCKS, LARGEST, SIDE = 24, 65536, 2048
#: Points of a box of the neighbour search, members that give its first bound, and the most queries of a tile.
LEAF, FIRST, QUERIES = 32, 2048, 32768


def block_rows(n: int, least: int) -> int:
    """Rows of a block: a share of the table, so that each row is sent to BLOCKS blocks however large the table is (up to BLOCKS x LARGEST rows)."""
    return max(least, min(LARGEST, -(-n // BLOCKS)))


def spread_out(points: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first pivots: each is the point farthest from those before. Stops where all points coincide with a pivot."""
    if not len(points):
        return points
    chosen = [0]
    far = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < most and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0))


@dataclass
class Cells:
    """Points with their cell, and the table of cells (at most PIVOTS x SPLIT rows, on the driver)."""

    points: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    rows: int

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) possible distance between members of two cells."""
        d = distances(self.pivots, self.pivots)
        np.fill_diagonal(d, 0.0)
        reach = self.radius[:, None] + self.radius[None, :]
        return np.maximum(d - reach - SLACK, 0.0), d + reach + SLACK

    def products(self, pairs: np.ndarray) -> int:
        """Vector products that comparing these pairs of cells (upper triangle) takes, against n (n - 1) / 2 for all."""
        a, b = np.nonzero(np.triu(pairs))
        n = self.size.astype(object)
        return int(sum(n[i] * (n[i] - 1) // 2 if i == j else n[i] * n[j] for i, j in zip(a.tolist(), b.tolist(), strict=True)))

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, chunk, block) of every piece: cells in their order, those beyond a block's rows in hash chunks, packed into blocks of about equal size."""
        chunks = np.maximum(1, -(-self.size // block_rows(int(self.size.sum()), self.rows)))
        cell = np.repeat(np.arange(len(self.size)), chunks)
        chunk = np.concatenate([np.arange(c) for c in chunks]) if len(chunks) else np.zeros(0, dtype=np.int64)
        held = np.cumsum((self.size / chunks)[cell])
        return cell, chunk, ((held - 1e-9) // block_rows(int(self.size.sum()), self.rows)).astype(np.int64)

    def tiles(self, pairs: np.ndarray, fn: Callable, schema: str, key: str) -> DataFrame:
        """fn(parts) for every pair of blocks that holds a marked pair of cells. parts yields (left, right, keep): two dicts of arrays (a matrix for an array column) of at most
        SIDE rows, and None or the mask of the products that count once (by position, not by key).

        A row travels once to each block it is compared with, not once to each cell. Blocks grow with the table up to LARGEST rows, so what is shuffled follows the rows.
        """
        spark = self.points.sparkSession
        marked = np.triu(pairs) | np.triu(pairs).T
        if not marked.any():
            return spark.createDataFrame([], schema)
        cell, chunk, block = self.pieces()
        n = int(block.max()) + 1
        belongs = np.zeros((len(self.size), n), dtype=bool)
        belongs[cell, block] = True
        meets = marked.astype(int) @ belongs > 0  # cell x block
        where = pd.DataFrame({"_cell": cell, "_chunk": chunk, "_block": block, "_chunks": np.bincount(cell, minlength=len(self.size))[cell]})
        where["_meets"] = [np.flatnonzero(meets[c]).tolist() for c in cell]
        where = spark.createDataFrame(where, "_cell int, _chunk int, _block int, _chunks int, _meets array<int>")
        many = F.broadcast(where.filter("_chunk = 0").select("_cell", "_chunks"))
        t = self.points.withColumn("_cell", F.col("_cell").cast("int")).join(many, "_cell").withColumn("_chunk", (h60(key) % F.col("_chunks")).cast("int")).drop("_chunks")
        t = t.join(F.broadcast(where.drop("_chunks")), ["_cell", "_chunk"]).withColumn("_other", F.explode("_meets")).drop("_meets")
        t = t.withColumns({"_ta": F.least("_block", "_other"), "_tb": F.greatest("_block", "_other")}).drop("_other")
        shipped = spark.sparkContext.broadcast(marked)
        columns = self.points.columns

        def tile(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_block", "_cell", "_chunk", key], kind="stable")
            table = {c: np.stack(pdf[c].to_numpy()) if pdf[c].dtype == object and isinstance(pdf[c].iloc[0], (np.ndarray, list)) else pdf[c].to_numpy() for c in columns}
            cells_of, own = pdf["_cell"].to_numpy(), pdf["_block"].to_numpy()
            names = pdf[["_block", "_cell", "_chunk"]].to_numpy()
            edge = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1, [len(pdf)]])
            same = bool(pdf["_ta"].iloc[0] == pdf["_tb"].iloc[0])
            first = len(pdf) if same else int((own == pdf["_ta"].iloc[0]).sum())

            def take(rows) -> dict:
                return {c: v[rows] for c, v in table.items()}

            def parts():
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if a >= first:
                        break
                    # inside a block a piece meets itself and those after it; else all pieces of the other block
                    hit = np.flatnonzero(shipped.value[cells_of[a], cells_of[(a if same else first):]]) + (a if same else first)
                    for i in range(a, b, SIDE):
                        left = take(slice(i, min(i + SIDE, b)))
                        ahead = hit[hit >= i] if same else hit
                        for j in range(0, len(ahead), SIDE):
                            at = ahead[j:j + SIDE]
                            yield left, take(at), None if at[0] >= min(i + SIDE, b) else np.arange(i, min(i + SIDE, b))[:, None] < at[None, :]

            return fn(parts())

        return t.groupBy("_ta", "_tb").applyInPandas(tile, schema)


def _assigned(points: DataFrame, vec: str, pivots: np.ndarray, offset: int = 0) -> DataFrame:
    """points with _cell (nearest pivot, ties to the first) and _reach (distance to it)."""
    @F.pandas_udf("struct<cell: int, reach: double>")
    def nearest_pivot(x: pd.Series) -> pd.DataFrame:
        d = distances(np.stack(x.to_numpy()).astype(float), pivots) if len(x) else np.zeros((0, len(pivots)))
        at = d.argmin(axis=1)
        return pd.DataFrame({"cell": at + offset, "reach": d[np.arange(len(d)), at]})

    return points.withColumn("_p", nearest_pivot(vec)).withColumn("_cell", F.col("_p.cell")).withColumn("_reach", F.col("_p.reach")).drop("_p")


def _sampled(points: DataFrame, key: str, vec: str, n: int) -> np.ndarray:
    rows = points.select(h60(key, F.lit("pivot")).alias("h"), F.col(key).alias("k"), vec).orderBy("h", "k").limit(n).collect()
    return np.array([r[vec] for r in rows], dtype=float)


def cells(points: DataFrame, key: str, vec: str, rows: int = 2048, pivots: int = PIVOTS, split: int = SPLIT) -> Cells:
    """Assign points (one row per key, vectors of one length) to cells. Cells of more than `rows` points are split once by pivots of their own."""
    first = spread_out(_sampled(points, key, vec, SAMPLE), pivots)
    if not len(first):
        return Cells(points.withColumn("_cell", F.lit(0)), np.zeros((0, 1)), np.zeros(0), np.zeros(0, dtype=np.int64), rows)
    placed = shared(_assigned(points, vec, first))
    stats = {r["_cell"]: (r["n"], r["r"]) for r in placed.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_reach").alias("r")).collect()}
    large = [c for c, (n, r) in sorted(stats.items()) if n > rows and r > SLACK]
    names, parts = [c for c in sorted(stats) if c not in large], []
    every = [first[c] for c in names]
    small = placed.filter(~F.col("_cell").isin(large)) if large else placed
    renamed = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i)]) if names else None
    if names:
        parts.append(small.withColumn("_cell", renamed[F.col("_cell")]))
    if large:
        # one pass: the split cells' samples together, then each point against the pivots of its own cell
        pick = W.partitionBy("_cell").orderBy("_h", key)
        chosen = placed.filter(F.col("_cell").isin(large)).withColumn("_h", h60(key, F.lit("split"))).withColumn("_rn", F.row_number().over(pick)).filter(F.col("_rn") <= SAMPLE // 8)
        by: dict[int, list] = {}
        for r in chosen.select("_cell", vec).collect():
            by.setdefault(r["_cell"], []).append(r[vec])
        own = {c: spread_out(np.array(v, dtype=float), split) for c, v in by.items()}
        start = {}
        for c in large:
            start[c] = len(every)
            every += list(own[c])

        @F.pandas_udf("struct<cell: int, reach: double>")
        def deeper(cell: pd.Series, x: pd.Series) -> pd.DataFrame:
            out = pd.DataFrame({"cell": np.zeros(len(x), dtype=int), "reach": np.zeros(len(x))})
            y = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, 1))
            for c in np.unique(cell):
                rows_of = np.flatnonzero(cell.to_numpy() == c)
                d = distances(y[rows_of], own[int(c)])
                at = d.argmin(axis=1)
                out.loc[rows_of, "cell"], out.loc[rows_of, "reach"] = at + start[int(c)], d[np.arange(len(d)), at]
            return out

        parts.append(placed.filter(F.col("_cell").isin(large)).withColumn("_p", deeper("_cell", vec)).withColumn("_cell", F.col("_p.cell")).withColumn("_reach", F.col("_p.reach")).drop("_p"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = shared(out)
    final = {r["_cell"]: (r["n"], r["r"]) for r in out.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_reach").alias("r")).collect()}
    size = np.array([final.get(i, (0, 0.0))[0] for i in range(len(every))], dtype=np.int64)
    radius = np.array([final.get(i, (0, 0.0))[1] for i in range(len(every))], dtype=float)
    return Cells(out.drop("_reach"), np.array(every), radius, size, rows)


def halves(x: np.ndarray, i: np.ndarray) -> list[np.ndarray]:
    """The points i of x, cut in two at the middle of their widest side."""
    p = x[i]
    o, h = np.argpartition(p[:, np.argmax(p.max(0) - p.min(0))], len(i) // 2), len(i) // 2
    return [i[o[:h]], i[o[h:]]]


def leaves(x: np.ndarray, i: np.ndarray, size: int) -> list[np.ndarray]:
    done, todo = [], [i]
    while todo:
        i = todo.pop()
        if len(i) > size:
            todo += halves(x, i)
        else:
            done.append(i)
    return done


def gaps(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of boxes a..b to boxes lo..hi."""
    out = np.zeros((len(a), len(lo)))
    for d in range(a.shape[1]):
        out += np.maximum(np.maximum(lo[None, :, d] - b[:, None, d], a[:, None, d] - hi[None, :, d]), 0.0) ** 2
    return out


def nearest_rows(x: np.ndarray, y: np.ndarray, xk: np.ndarray, yk: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2): the k nearest rows y[j] of every x[i], ties to the first of them, without rows of the same key. The rows of y come in the order of their keys.

    Both sides are cut into boxes of few points. The k-th distance to the members of some near boxes excludes the boxes, then the members, that are farther; points that
    leave too many are cut further. Of equal rows the first k + 1 are enough.
    """
    points, finite = np.flatnonzero(np.isfinite(x).all(1)), np.flatnonzero(np.isfinite(y).all(1))  # others have no neighbours and are none
    if not (len(points) and len(finite)):
        return points[:0], finite[:0], np.empty(0)
    order = finite[np.lexsort((finite, *y[finite].T))]
    sorted_y = y[order]
    start = np.flatnonzero(np.r_[True, (sorted_y[1:] != sorted_y[:-1]).any(1)])
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    kept = np.sort(order[place <= k])
    y, yk = y[kept], yk[kept]
    boxes = leaves(y, np.arange(len(y)), LEAF)
    lo, hi, size = np.array([y[b].min(0) for b in boxes]), np.array([y[b].max(0) for b in boxes]), np.array([len(b) for b in boxes])
    yy, xx = (y * y).sum(1), (x * x).sum(1)
    found: list[tuple] = []

    def members(near: np.ndarray) -> np.ndarray:
        return np.sort(np.concatenate([boxes[b] for b in near]))

    todo = leaves(x, points, 2 * LEAF)
    while todo:
        i = todo.pop()
        gap = gaps(x[i].min(0)[None], x[i].max(0)[None], lo, hi)[0]
        first = np.argsort(gap, kind="stable")
        j = members(first[: np.searchsorted(np.cumsum(size[first]), max(FIRST, 2 * k)) + 1])
        kth = np.full(len(i), np.inf)
        if len(j) >= k:
            d = np.maximum(xx[i][:, None] + yy[j][None, :] - 2 * x[i] @ y[j].T, 0.0)
            d[xk[i][:, None] == yk[j][None, :]] = np.inf
            kth = np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + SLACK + 1e-14 * (xx[i] + yy.max())
        near = np.flatnonzero(gap <= kth.max())
        near = near[(gaps(x[i], x[i], lo[near], hi[near]) <= kth[:, None]).any(0)]
        if len(i) > 1 and size[near].sum() * len(i) > SIDE * SIDE:
            todo += halves(x, i)
            continue
        j = members(near)
        dot = x[i] @ y[j].T
        r, c = np.nonzero((yy[j][None, :] - 2 * dot <= (kth - xx[i])[:, None]) & (xk[i][:, None] != yk[j][None, :]))
        v = np.maximum(xx[i[r]] + yy[j[c]] - 2 * dot[r, c], 0.0).round(9)
        o = np.lexsort((c, v, r))
        r, c, v = r[o], c[o], v[o]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        found.append((i[r[best]], kept[j[c[best]]], v[best]))
    return tuple(np.concatenate(f) for f in zip(*found))


def k_nearest(query: DataFrame, ref: DataFrame, key: str, vec: str, k: int, by: Sequence[str] = (), rows: int = 2048, pivots: int = PIVOTS) -> DataFrame:
    """Exact k nearest reference rows (Euclidean, ties by key) of every query row inside its group: (by, key, nb, rank, d2). A row is not its own neighbour.

    Each group has up to `pivots` pivots (the smallest hashes), so a large group is many cells. A query is first compared with its own cell; its k-th distance there then
    excludes the cells whose nearest possible member is farther. Cells beyond `rows` points are met in chunks, and a tile returns at most k rows per query.
    """
    by = list(by)
    types = dict(query.dtypes)
    side = [*by, key, vec]
    q, r = query.select(*side), ref.select(*side)
    one = by or ["_all"]
    if not by:
        q, r = q.withColumn("_all", F.lit(0)), r.withColumn("_all", F.lit(0))
    total = r.groupBy(*one).agg(F.count("*").alias("_n"))
    # with few groups a join on them would send a group to one task; with many the tables are as long as the rows
    few = F.broadcast if total.limit(FEW + 1).count() <= FEW else lambda t: t
    ranked = hash_rank(r.withColumn("_h", h60(key, F.lit("pivot"))), one, "_h", key, "_rn")
    piv = ranked.join(few(total), one).filter(F.col("_rn") <= F.least(F.lit(pivots), F.ceil(F.sqrt("_n")))).groupBy(*one).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rn").cast("int").alias("p"), F.col(vec).alias("x")))).alias("_piv"))

    def far(a, b):
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))

    piv = shared(piv)

    def placed(t: DataFrame) -> DataFrame:
        d = F.array_min(F.transform("_piv", lambda p: F.struct(far(F.col(vec), p["x"]).alias("d"), p["p"].alias("p"))))
        return t.join(few(piv), one).withColumn("_d", d).withColumn("_cell", F.col("_d.p")).withColumn("_reach", F.col("_d.d")).drop("_d", "_piv")  # the pivots are far longer than a row

    r = shared(placed(r))
    boxes = r.groupBy(*one, "_cell").agg(F.count("*").alias("n"), F.max("_reach").alias("r"))
    table = boxes.groupBy(*one).agg(F.map_from_entries(F.collect_list(F.struct("_cell", F.struct("n", "r").alias("c")))).alias("_cells"))
    table = shared(table.join(piv, one))
    q = shared(placed(q).withColumn("_home", F.col("_cell")).drop("_cell", "_reach"))
    schema = ", ".join([f"`{c}` {types.get(c, 'int')}" for c in [*one, key]] + [f"nb {types[key]}", "d2 double"])
    names = [*one, key, "nb", "d2"]

    def chunk_count(n):
        return F.ceil(n / rows).cast("int")

    def compared(pairs: DataFrame) -> DataFrame:
        """pairs: query rows with one cell each. Reference chunks meet query chunks."""
        counts = pairs.groupBy(*one, "_cell").agg(F.count("*").alias("_nq"))
        sizes = shared(counts.join(boxes, [*one, "_cell"]).select(*one, "_cell", F.ceil(F.col("_nq") / min(rows, QUERIES)).cast("int").alias("_qs"), chunk_count(F.col("n")).alias("_rs")))
        zero = F.lit(0)
        a = pairs.join(few(sizes), [*one, "_cell"]).withColumn("_qb", (h60(key) % F.col("_qs")).cast("int")).withColumn("_rb", F.explode(F.sequence(zero, F.col("_rs") - 1)))
        b = r.join(few(sizes), [*one, "_cell"]).withColumn("_rb", (h60(key) % F.col("_rs")).cast("int")).withColumn("_qb", F.explode(F.sequence(zero, F.col("_qs") - 1)))
        cols = [*one, "_cell", "_qb", "_rb", key, vec]

        def tile(pdf: pd.DataFrame) -> pd.DataFrame:
            left, right = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1].sort_values(key)
            if not (len(left) and len(right)):
                return pd.DataFrame(columns=names)
            x, y = np.stack(left[vec].to_numpy()).astype(float), np.stack(right[vec].to_numpy()).astype(float)
            i, j, d2 = nearest_rows(x, y, left[key].to_numpy(), right[key].to_numpy(), k)
            out = left[[*one, key]].iloc[i].reset_index(drop=True)
            out["nb"], out["d2"] = right[key].to_numpy()[j], d2
            return out[names]

        both = a.select(*cols, F.lit(0).alias("_side")).union(b.select(*cols, F.lit(1).alias("_side")))
        return both.groupBy(*one, "_cell", "_qb", "_rb").applyInPandas(tile, schema)

    def best(found: DataFrame) -> DataFrame:
        w = W.partitionBy(*one, key).orderBy("d2", "nb")  # at most k rows for each reference chunk met
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    home = shared(best(compared(q.select(*one, key, vec, F.col("_home").alias("_cell")))))
    bound = home.groupBy(*one, key).agg(F.max("d2").alias("_kth"), F.count("*").alias("_found"))
    reach = F.when(F.col("_found") >= k, F.sqrt("_kth") + SLACK)
    others = F.filter("_piv", lambda p: (p["p"] != F.col("_home")) & F.col("_cells")[p["p"]].isNotNull() & (
        F.col("_reach").isNull() | (far(F.col(vec), p["x"]) - F.col("_cells")[p["p"]]["r"] - SLACK <= F.col("_reach"))))
    more = q.join(bound, [*one, key], "left").join(few(table), one).withColumn("_reach", reach).select(*one, key, vec, F.explode(F.transform(others, lambda p: p["p"])).alias("_cell"))
    return best(home.select(*names).union(compared(more))).select(*by, key, "nb", "rank", "d2")
