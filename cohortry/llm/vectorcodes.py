"""Vector code compression: product codes from exact integer k-means over Hilbert-sorted flat blocks.

1. Components become floor(256 x). A vector is cut into equal consecutive parts; every part position has its own codebook.
2. Each task turns the vectors it reads into chunks. In a chunk, each part position's points are ordered along a Hilbert curve and laid out as flat blocks, each with the
   box (least and largest component) and the component sums of its points. Blocks are written once; vectors are never shuffled.
3. A round reads the blocks. For a block, the squared distances from each codebook entry to the nearest and to the farthest corner of the box bound its distance to
   every point: an entry whose nearest is beyond the least farthest cannot win, the others are the block's shortlist. One entry left: the block's stored sums are
   added as they are. Otherwise an integer kernel compares the block's points with the shortlist. All bounds are integers, so the result is that of full comparison.
4. Only sums and counts per entry leave a task; codebooks are (parts x entries x width) integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components that a chunk holds at most, and points in a block.
CHUNK_COMPONENTS, BLOCK = 1 << 21, 64
#: Components beyond this would take squared distances out of 64 bits.
LARGEST = 1 << 24


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Place of each point (rows of small non-negative integers) on a Hilbert curve through the cube that holds them: Skilling's transform on all rows at once. Points
    of more than 16 dimensions are placed by their first 16."""
    x = points[:, :16].astype(np.uint64).T.copy()
    dims = len(x)
    bits = max(1, min(60 // max(1, dims), 10))
    top = int(points.max(initial=0)).bit_length()
    x = x >> np.uint64(top - bits) if top > bits else x
    one = np.uint64(1)
    for q in (one << np.uint64(b) for b in range(bits - 1, 0, -1)):
        low = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (one << np.uint64(b) for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


class Blocks:
    """The points of one part position of a chunk in Hilbert order, cut into blocks."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None):
        if order is None:
            order = np.argsort(hilbert_keys(points - points.min(axis=0)), kind="stable").astype(np.int32)
            points = points[order]
        self.order, self.points = order, points
        starts = np.arange(0, len(points), BLOCK)
        self.low, self.high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
        self.sums = np.add.reduceat(points.astype(np.int64), starts)
        self.spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(points)], strict=True))

    def shortlists(self, book: np.ndarray) -> np.ndarray:
        """(block, entry): may the entry be nearest to a point of the block?"""
        low, high, e = self.low[:, None].astype(np.int64), self.high[:, None].astype(np.int64), book[None]
        nearest = (np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(axis=2)
        farthest = (np.maximum(np.abs(e - low), np.abs(e - high)) ** 2).sum(axis=2)
        return nearest <= farthest.min(axis=1, keepdims=True)

    def gathered(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, component sums) of the points per nearest entry."""
        counts, sums = np.zeros(len(book), dtype=np.int64), np.zeros(book.shape, dtype=np.int64)
        for k, ((a, b), may) in enumerate(zip(self.spans, self.shortlists(book), strict=True)):
            some = np.flatnonzero(may)
            if len(some) == 1:
                counts[some[0]] += b - a
                sums[some[0]] += self.sums[k]
                continue
            own = some[nearest_entries(self.points[a:b], book[some])[0]]
            counts += np.bincount(own, minlength=len(book))
            np.add.at(sums, own, self.points[a:b])
        return counts, sums

    def coded(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) per point, in the chunk's own row order."""
        code, error = np.empty(len(self.points), dtype=np.uint8), np.empty(len(self.points), dtype=np.int64)
        for (a, b), may in zip(self.spans, self.shortlists(book), strict=True):
            some = np.flatnonzero(may)
            own, far = nearest_entries(self.points[a:b], book[some])
            code[self.order[a:b]], error[self.order[a:b]] = some[own], far
        return code, error


def nearest_entries(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, ties to the lower one; its squared distance), in exact 64-bit integers."""
    far = np.zeros((len(points), len(entries)), dtype=np.int64)
    for k in range(points.shape[1]):
        far += (points[:, k, None].astype(np.int64) - entries[None, :, k]) ** 2
    own = far.argmin(axis=1)
    return own, far[np.arange(len(points)), own]


def grid(vectors: pd.Series, parts: int) -> np.ndarray:
    """floor(256 x) of equal-length vectors as (rows, parts, width) integers; widths that do not divide are filled up with zeros."""
    x = np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * 256).astype(np.int32)
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def blocks_of(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """Chunks of the vectors as flat blocks: ids and labels in row order; per part position, points in Hilbert order and their row numbers."""
    most = max(1, CHUNK_COMPONENTS // max(1, length))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, labels, x in chunks(frames):
            made = [Blocks(np.ascontiguousarray(x[:, p])) for p in range(parts)]
            yield pd.DataFrame({"ids": [ids], "labels": [labels], "points": [[b.points.tobytes() for b in made]], "orders": [[b.order.tobytes() for b in made]]})

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list, np.ndarray]]:
        ids, labels, held = [], [], []
        for frame in frames:
            for k in range(0, len(frame), most):
                some = frame.iloc[k:k + most]
                if held and len(ids) + len(some) > most:
                    yield ids, labels, np.concatenate(held)
                    ids, labels, held = [], [], []
                ids, labels = ids + some["vec_id"].astype("Int64").tolist(), labels + some["label"].tolist()
                held.append(grid(some["embedding"], parts))
        if held:
            yield ids, labels, np.concatenate(held)

    return rows.mapInPandas(run, "ids array<long>, labels array<string>, points array<binary>, orders array<binary>")


def _parted(row, width: int) -> Iterator[Blocks]:
    for points, order in zip(row.points, row.orders, strict=True):
        yield Blocks(np.frombuffer(points, dtype=np.int32).reshape(-1, width), np.frombuffer(order, dtype=np.int32))


def gather(blocks: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of all points per (part, entry): each task adds up its chunks, one shuffle adds up the tasks."""
    parts, entries, width = books.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for frame in frames:
            for row in frame.itertuples():
                for p, b in enumerate(_parted(row, width)):
                    n, s = b.gathered(books[p])
                    counts[p] += n
                    sums[p] += s
        used = np.flatnonzero(counts.ravel())
        yield pd.DataFrame({"at": used, "n": counts.ravel()[used], "sums": pd.Series(list(sums.reshape(-1, width)[used]), dtype=object)})

    each = blocks.select("points", "orders").mapInPandas(run, "at long, n long, sums array<long>")
    flat = each.select("at", F.lit(-1).alias("k"), F.col("n").alias("x")).union(each.select("at", F.posexplode("sums").alias("k", "x")))
    counts, sums = np.zeros(parts * entries, dtype=object), np.zeros((parts * entries, width), dtype=object)
    for r in flat.groupBy("at", "k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        if r["k"] < 0:
            counts[r["at"]] = int(r["x"])
        else:
            sums[r["at"], r["k"]] = int(r["x"])
    return counts.reshape(parts, entries), sums.reshape(books.shape)


def codebooks(rows: DataFrame, blocks: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """(parts, entries, width) integers: the parts of the vectors of the smallest ids, moved `rounds` times to the floor of their points' mean."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).toPandas()
    books = grid(first["embedding"], parts).transpose(1, 0, 2).astype(np.int64).copy()
    for _ in range(rounds):
        counts, sums = gather(blocks, books)
        used = counts > 0
        books[used] = [[int(x) // int(n) for x in s] for s, n in zip(sums[used], counts[used], strict=True)]
    return books


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, label (as text) and ok: finite and of a size that 64-bit distances hold. Null vectors and those with a null or non-finite component are left out."""
    x = F.col("embedding")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    kept = kept.filter(x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return kept.withColumn("ok", (F.size("embedding") > 0) & ~F.exists("embedding", lambda c: F.abs(c) * 256 > LARGEST))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code (two hex digits a part), error (squared distance), label_error (error of all rows with the same label, nulls together),
    codebooks_sha256.

    Null vectors and vectors with a null or non-finite component are dropped. Ids may repeat (each row is coded) or be null (they come after all others when the
    first codebook is taken; rows of equal id by their components). With fewer rows than entries the codebook has as many entries as rows. All vectors have one
    length: rows of another than the most frequent (of several, the longest), rows without components, and rows with a component beyond 65,536 have a null code
    and error and take no part in codebooks. Lengths that `parts` does not divide are filled up with zeros. An empty table gives no row.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    every = usable(vectors)
    found = every.filter("ok").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = found["n"] if found else 0
    fits = F.col("ok") & (F.size("embedding") == length)
    rows, rest = every.filter(fits).drop("ok"), every.filter(~fits)
    blocks = cut(blocks_of(rows, length, parts))
    books = codebooks(rows, blocks, parts, entries, rounds) if found else np.zeros((parts, 0, 0), dtype=np.int64)
    width = books.shape[2]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                codes, error = [], 0
                for p, b in enumerate(_parted(row, width)):
                    code, far = b.coded(books[p])
                    codes.append(code)
                    error = error + far
                code = np.stack(codes, axis=1).tobytes().hex()
                step = 2 * len(books)
                yield pd.DataFrame({
                    "vec_id": pd.array(list(row.ids), dtype="Int64"), "label": list(row.labels),
                    "code": [code[k:k + step] for k in range(0, len(code), step)], "error": error})

    coded = blocks.mapInPandas(run, "vec_id long, label string, code string, error long")
    coded = cut(coded.union(rest.select("vec_id", "label", F.lit(None).cast("string"), F.lit(None).cast("long"))))
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB: full comparison of every part with every entry. For vectors of one length that `parts` divides."""
    sql = f"""
with kept as (select row_number() over (order by vec_id) as i, * from embeddings
              where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as (select i, k // (len(embedding) // {parts}) as p, k % (len(embedding) // {parts}) as c, cast(floor(256 * cast(embedding[k + 1] as double)) as bigint) as v
      from (select *, unnest(range(len(embedding))) as k from kept)),
point as (select i, p, list(v order by c) as v from x group by all),
book0 as (select p, i - 1 as e, v from point where i <= {entries})"""

    def near(k: int) -> str:
        return f"""
near{k} as (select i, p, min(struct_pack(d := d, e := e)) as best from
  (select i, point.p, e, list_sum(list_transform(list_zip(point.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from point join book{k} b on b.p = point.p) group by all)"""

    for k in range(rounds):
        sql += f""",{near(k)},
mean{k} as (select p, e, list(m order by c) as v from (select n.p, best.e as e, c, cast(floor(cast(sum(v) as double) / count(*)) as bigint) as m
  from near{k} n join x on x.i = n.i and x.p = n.p group by all) group by all),
book{k + 1} as (select b.p, b.e, coalesce(m.v, b.v) as v from book{k} b left join mean{k} m on m.p = b.p and m.e = b.e)"""
    return sql + f""",{near(rounds)},
coded as (select i, string_agg(lpad(to_hex(best.e), 2, '0'), '' order by p) as code, cast(sum(best.d) as bigint) as error from near{rounds} group by i),
books as (select lower(sha256(string_agg(array_to_string(v, ','), ',' order by p, e))) as h from book{rounds})
select vec_id, lower(code) as code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256
from kept join coded using (i), books"""
