"""Near-duplicate documents by a chosen-path set similarity join.

1. A document's set of word shingles is hashed to 64 bits. Equal sets are one class; only the smallest (doc_id, text) of it goes on.
2. Each class has 128 minwise tokens. In each of `trees` independent trees a node holds the classes that took the same path. A node with at most `small`
   classes is compared exhaustively; a larger one branches: one or two of the 128 positions are chosen by the hash of the node (1.25 on average, 1 / 0.8), and
   each class goes to the child of its token there. A pair of similarity 0.8 meets on average once per tree at any depth, so independent trees are
   repeated (see `TREES` for the chance that a pair is missed). A larger node ends as well when few of its classes stand outside its largest label, or none is
   large: then it takes fewer comparisons than its classes would take rows further down.
3. Comparison in a node uses 128 one-bit samples of the tokens: 100 agreeing bits or more (115 expected at 0.8, deviation 3.4) make a candidate link. A node gives a
   spanning forest of its candidate links, never all pairs.
4. Candidate components gather the full sets of their members, each set once, and links are confirmed on full sets: every component of the links with
   100 * intersection >= 80 * union is found by a walk that compares a member only with members not yet reached.
5. Large groups of near copies are found first: one walk down `HUB_TREES` trees compares the classes of a node with its smallest class alone, and what it links goes no
   deeper. Their confirmed components are labels; then all trees are built, and a node whose classes carry one label ends: it can give no new link. Mixed nodes
   and components are compared across labels only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import by_key, components, held_table, id_text, slices

TOKENS = 128
#: Nodes up to this size are compared exhaustively; depth at which a node is compared whatever its size (in chunks of `CHUNK`).
SMALL, DEPTH, CHUNK = 48, 6, 2048
#: Comparisons that a node of at most `CHUNK` classes may take besides (classes outside its largest label, each with all): they are done at once in numpy, about
#: 10 ms; branching would write the node's rows once a level more, in every tree.
ROOM = 1 << 20
#: Chance of a pair at 0.8 to meet in one tree is about 0.48 at the full depth and higher in nodes that end earlier. All trees draw from the same tokens:
#: averaged over how many of them match, 12 trees and the bit filter miss 1.4 in 1000 (0.4 at the mean number).
TREES = 12
AGREE = 100
#: Trees in which near copies of a node's smallest class are looked for before anything else; levels of them.
HUB_TREES, HUB_DEPTH = 3, 2
#: Shingles of a candidate component that one task compares at once; a larger component is dealt to more tasks (see `dealt`).
TASK_SHINGLES = 600_000
CACHED_WORDS = 200_000
_A = np.random.default_rng(11).integers(1, 2**63, TOKENS, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(12).integers(0, 2**63, TOKENS, dtype=np.uint64)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingles:
    """Distinct 64-bit hashes of the word shingles of a text. Words: runs of anything but space and \\t..\\r, A-Z lowered."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if new := set(words).difference(known):
            if len(known) + len(new) > CACHED_WORDS:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.words, len(h))
        if not k:
            return h
        with np.errstate(over="ignore"):
            x = np.full(len(h) - k + 1, k, dtype=np.uint64)
            for i in range(k):
                x = (x ^ h[i:len(h) - k + 1 + i]) * _P
                x ^= x >> np.uint64(29)
            x = (x * _Q) ^ (x >> np.uint64(32))
        return np.unique(x)


def shingles_of(words: int) -> Shingles:
    """One table per worker process."""
    return held_table(("shingles", words), lambda: Shingles(words))


def tokens(x: np.ndarray) -> np.ndarray:
    """128 minwise tokens (int32) of a set of hashes."""
    best = np.full(TOKENS, np.iinfo(np.uint32).max, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(x), 4096):
            best = np.minimum(best, ((x[k:k + 4096, None] * _A + _B) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return best.view(np.int32)


def hashed_text(docs: DataFrame) -> DataFrame:
    """id_text with `th`, a hash of the text: with the id it names a row where ids repeat."""
    return id_text(docs).withColumn("th", F.xxhash64("text"))


def digest_of(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def signed_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th, n, digest (16 bytes, null for an empty set), tokens, bits_a, bits_b per document."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = shingles_of(words)
        place = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for frame in frames:
            for some in slices(frame):
                rows = []
                for doc_id, text, th in zip(some["doc_id"], some["text"], some["th"], strict=True):
                    x = shingles.of(text)
                    if not len(x):
                        rows.append((doc_id, th, 0, None, None, 0, 0))
                        continue
                    t = tokens(x)
                    with np.errstate(over="ignore"):
                        one = ((t.view(np.uint32).astype(np.uint64) * _P) >> np.uint64(63)).astype(bool)
                    bits = [int(np.uint64(place[one[k:k + 64]].sum(dtype=np.uint64)).view(np.int64)) for k in (0, 64)]
                    rows.append((doc_id, th, len(x), digest_of(x), t, *bits))
                yield pd.DataFrame(rows, columns=["doc_id", "th", "n", "digest", "tokens", "bits_a", "bits_b"]).astype({"doc_id": "Int64"})

    return hashed_text(docs).mapInPandas(run, "doc_id long, th long, n long, digest binary, tokens array<int>, bits_a long, bits_b long")


def _branch(node: F.Column, level: int, t: F.Column) -> F.Column:
    """Children of a node for a class with tokens t: one or two positions chosen by the node alone."""
    def child(salt: int) -> F.Column:
        at = F.pmod(F.xxhash64(node, F.lit(salt + 2 * level)), F.lit(TOKENS)).cast("int")
        return F.xxhash64(node, at, t[at])

    two = F.pmod(F.xxhash64(node, F.lit(-1 - level)), F.lit(4)) == 0
    return F.explode(F.when(two, F.array(child(0), child(1))).otherwise(F.array(child(0))))


def _by_label(labels: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rows in order of their labels, and the rows of each label."""
    order = np.argsort(labels, kind="stable")
    names, starts = np.unique(labels[order], return_index=True)
    return names, dict(zip(names.tolist(), np.split(order, starts[1:]), strict=True))


def _span(labels: np.ndarray, near_of) -> list[tuple[int, int]]:
    """Links (larger label, smaller label) that span the components of the items' links. `near_of(item, left)` gives the items among those marked in `left` that
    link with an item; items of one label are linked from the start."""
    _, rows_of = _by_label(labels)
    left = np.ones(len(labels), dtype=bool)
    out: list[tuple[int, int]] = []
    for seed in range(len(labels)):
        if not left[seed]:
            continue
        queue = rows_of[int(labels[seed])].tolist()
        left[queue] = False
        while queue:
            u = queue.pop()
            if not left.any():
                return out
            for other in np.unique(labels[near_of(u, left)]).tolist():
                mine = int(labels[u])
                out.append((max(mine, other), min(mine, other)))
                left[rows_of[other]] = False
                queue += rows_of[other].tolist()
    return out


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Label links that span the candidate links inside each (node, part); rows are sorted by them, and a node may span batches."""
    def solve(rows: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
        sizes = np.diff(starts)
        labels, bits = rows[:, 2], rows[:, 3:].view(np.uint64)
        two = starts[:-1][sizes == 2]
        near = two[np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1) <= TOKENS - AGREE]
        out = list(zip(np.maximum(labels[near], labels[near + 1]).tolist(), np.minimum(labels[near], labels[near + 1]).tolist(), strict=True))
        for at, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = bits[at:at + n]

            def near_of(u: int, left: np.ndarray, own: np.ndarray = own) -> np.ndarray:
                rest = np.flatnonzero(left)
                return rest[np.bitwise_count(own[rest] ^ own[u]).sum(axis=1) <= TOKENS - AGREE]

            out += _span(labels[at:at + n], near_of)
        out = [p for p in out if p[0] != p[1]]
        return pd.DataFrame({"a": np.array([a for a, _ in out], dtype=np.int64), "b": np.array([b for _, b in out], dtype=np.int64)})

    held = np.zeros((0, 5), dtype=np.int64)
    for frame in frames:
        rows = np.concatenate([held, frame[["node", "part", "label", "bits_a", "bits_b"]].to_numpy(dtype=np.int64)])
        if not len(rows):
            continue
        starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
        held = rows[starts[-1]:].copy()
        yield solve(np.ascontiguousarray(rows[:starts[-1]]), starts)
    if len(held):
        yield solve(held, np.array([0, len(held)]))


def dealt(items: DataFrame, key: str, size: F.Column, room: int) -> DataFrame:
    """Add `part` to items (key, label, cid, ...): tasks that together hold every pair of items of a group that differ in label. Groups of one label go.

    A group of at most `room` is one part. Of a larger one, the items of its largest label are cut into chunks and all others into chunks, and a part is a chunk of each:
    a group of one large label and few others is copied about once. Only what carries no label yet is compared chunk with chunk.
    """
    items = items.withColumn("_size", size.cast("long"))
    sums = items.groupBy(key, "label").agg(F.sum("_size").alias("_sum"))
    groups = sums.groupBy(key).agg(F.sum("_sum").alias("_total"), F.max("_sum").alias("_most"), F.max_by("label", F.struct("_sum", "label")).alias("_giant"), F.count("*").alias("_labels"))
    groups = cut(groups.filter("_labels > 1").select(key, "_giant", F.when(F.col("_total") > room, F.ceil(F.col("_most") / room)).otherwise(1).cast("long").alias("_giants"),
                                                F.when(F.col("_total") > room, F.ceil((F.col("_total") - F.col("_most")) / room)).otherwise(1).cast("long").alias("_others")))
    hashed = F.xxhash64("cid", F.lit(5))
    wide = F.lit(1_000_000_000).cast("long")
    zero = F.lit(0).cast("long")
    mine = F.when(F.col("label") == F.col("_giant"), F.pmod(hashed, F.col("_giants"))).otherwise(F.pmod(hashed, F.col("_others")))
    across = F.when(F.col("label") == F.col("_giant"), F.transform(F.sequence(zero, F.col("_others") - 1), lambda o: F.col("_mine") * wide + o)).otherwise(
        F.concat(F.transform(F.sequence(zero, F.col("_giants") - 1), lambda g: g * wide + F.col("_mine")),
                 F.transform(F.filter(F.sequence(zero, F.col("_others") - 1), lambda o: o != F.col("_mine")), lambda o: -(F.least(o, F.col("_mine")) * wide + F.greatest(o, F.col("_mine"))))))
    return items.join(groups, key).withColumn("_mine", mine).withColumn("part", F.explode(across)).drop("_size", "_giant", "_giants", "_others", "_mine")


def hub_links(classes: DataFrame, trees: int = HUB_TREES, depth: int = HUB_DEPTH) -> DataFrame:
    """Candidate links (a, b) of classes with the smallest class of a node they pass. What is linked, and the smallest class itself, goes no deeper."""
    here = classes.select("cid", "tokens", "bits_a", "bits_b", F.explode(F.sequence(F.lit(-trees), F.lit(-1))).alias("_tree"))
    here = here.withColumn("node", _branch(F.xxhash64(F.lit("hub"), "_tree"), 0, F.col("tokens"))).drop("tokens")
    out = None
    for level in range(1, depth + 1):
        here = cut(here)
        hubs = here.groupBy("node").agg(F.min("cid").alias("_hub"), F.count("*").alias("_n"), F.min_by("bits_a", "cid").alias("_a"), F.min_by("bits_b", "cid").alias("_b"))
        hubs = cut(hubs.filter(F.col("_n") > SMALL))
        rows = here.join(hubs, "node")
        rows = rows.withColumn("near", F.bit_count(F.col("bits_a").bitwiseXOR(F.col("_a"))) + F.bit_count(F.col("bits_b").bitwiseXOR(F.col("_b"))) <= TOKENS - AGREE)
        links = rows.filter("near and cid > _hub").select(F.col("cid").alias("a"), F.col("_hub").alias("b"))
        out = links if out is None else out.union(links)
        wide = rows.filter("not near")
        if level == depth or hubs.isEmpty():
            break
        here = wide.select("cid", "bits_a", "bits_b", "node").join(classes.select("cid", "tokens"), "cid").select("cid", "bits_a", "bits_b", _branch(F.col("node"), level, F.col("tokens")).alias("node"))
    return out.distinct()


def candidate_links(classes: DataFrame, trees: int = TREES, small: int = SMALL, depth: int = DEPTH, room: int = ROOM) -> DataFrame:
    """Candidate links (a, b) between the labels of classes (cid, label, tokens, bits_a, bits_b)."""
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = classes.select("cid", "label", "tokens", "bits_a", "bits_b", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("_tree"))
    here = roots.select("cid", "label", "bits_a", "bits_b", _branch(F.xxhash64(F.lit("root"), "_tree"), 0, F.col("tokens")).alias("node"))
    out = None
    for level in range(1, depth + 1):
        here = cut(here)
        sizes = here.groupBy("node", "label").agg(F.count("*").alias("_n")).groupBy("node").agg(F.sum("_n").alias("size"), F.max("_n").alias("_most"), F.count("*").alias("_labels")).filter("_labels > 1")
        last = level == depth
        few = (F.col("size") <= small) | (F.col("size") <= CHUNK) & ((F.col("size") - F.col("_most")) * F.col("size") <= room)
        sizes = cut(sizes.select("node", "size", (F.lit(last) | few).alias("_ends")))
        rows = here.join(sizes, "node")
        ends = rows.filter(F.col("size") <= CHUNK if last else F.col("_ends")).withColumn("part", F.lit(0).cast("long"))
        if last:
            ends = ends.unionByName(dealt(rows.filter(F.col("size") > CHUNK), "node", F.lit(1), CHUNK).select(*ends.columns))
        links = ends.select("node", "part", "label", "bits_a", "bits_b").repartition(width, "node", "part").sortWithinPartitions("node", "part").mapInPandas(_links, "a long, b long")
        out = links if out is None else out.union(links)
        wide = rows.filter(~F.col("_ends"))
        if last or sizes.filter(~F.col("_ends")).isEmpty():
            break
        here = wide.select("cid", "label", "bits_a", "bits_b", "node").join(classes.select("cid", "tokens"), "cid").select(
            "cid", "label", "bits_a", "bits_b", _branch(F.col("node"), level, F.col("tokens")).alias("node"))
    return out.distinct()


def _walk(x: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Label links that span the links of the sets with 100 * intersection >= percent * union."""
    n = len(x)
    sizes = np.array([len(s) for s in x])
    flat = np.concatenate(x)
    order = np.argsort(flat, kind="stable")
    state = {"owner": np.repeat(np.arange(n, dtype=np.int32), sizes)[order], "flat": flat[order]}

    def near_of(u: int, left: np.ndarray) -> np.ndarray:
        alive = left[state["owner"]]
        if alive.sum() * 2 < len(alive):  # drop the postings of sets already reached
            state["owner"], state["flat"] = state["owner"][alive], state["flat"][alive]
        lo, hi = np.searchsorted(state["flat"], x[u], "left"), np.searchsorted(state["flat"], x[u], "right")
        shared = np.zeros(n, dtype=np.int64)
        for k in range(0, len(lo), 4096):
            spans = hi[k:k + 4096] - lo[k:k + 4096]
            at = np.repeat(lo[k:k + 4096] - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
            shared += np.bincount(state["owner"][at], minlength=n)
        return np.flatnonzero(left & (100 * shared >= percent * (sizes + sizes[u] - shared)) & (shared > 0))

    return _span(labels, near_of)


def confirmed_links(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Label links (a, b), confirmed on full sets, that span the components of the sets dealt to each (component, part). members: (component, part, cid, label, digest,
    rep, th): the text of a class is one whose set has its digest. Each task passes on one copy of a text that many equal rows hold."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = members.select("component", "part", "cid", "label", "digest", "rep", F.col("th").alias("_th"))
    text = hashed_text(docs).join(wanted, (F.col("doc_id") == F.col("rep")) & (F.col("th") == F.col("_th"))).select("component", "part", "cid", "label", "digest", "text")

    def once(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()
        for frame in frames:
            keys = list(zip(frame["component"], frame["part"], frame["cid"], strict=True))
            new = []
            for k in keys:
                new.append(k not in seen)
                seen.add(k)
            yield frame[new]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = shingles_of(words)
        for group in by_key(frames, ["component", "part"]):
            group = group.drop_duplicates("cid")
            if group["label"].nunique() < 2:
                continue
            sets = [shingles.of(t) for t in group["text"]]
            if any(digest_of(x) != bytes(d) for x, d in zip(sets, group["digest"], strict=True)):
                raise ValueError("two texts of one doc_id have the same hash")
            out = _walk(sets, group["label"].to_numpy(), percent)
            yield pd.DataFrame({"a": np.array([a for a, _ in out], dtype=np.int64), "b": np.array([b for _, b in out], dtype=np.int64)})

    schema = "component long, part long, cid long, label long, digest binary, text string"
    return text.mapInPandas(once, schema).repartition(width, "component", "part").sortWithinPartitions("component", "part", "cid").mapInPandas(run, "a long, b long")


def relabelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes with the labels of linked labels made one."""
    found = components(links).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return cut(classes.join(found, F.col("label") == F.col("_node"), "left").withColumn("label", F.coalesce("_component", "label")).drop("_node", "_component"))


def merged(docs: DataFrame, classes: DataFrame, candidates: DataFrame, words: int, percent: int) -> DataFrame:
    """classes (cid, label, n, rep, th, digest, ...) with the labels merged that confirmed links join, of those in one candidate component.

    A component beyond `TASK_SHINGLES` in which no label has half of all is first cut into chunks that share a few members: near copies of those get one label
    whatever their chunk. What still differs in label is then compared across chunks.
    """
    keep = classes.columns
    maybe = components(candidates).select(F.col("node").alias("_node"), "component")
    inside = ["component", "cid", "label", "n", "rep", "th", "digest"]
    members = cut(classes.join(maybe, F.col("label") == F.col("_node")).select(*inside))
    sums = members.groupBy("component", "label").agg(F.sum("n").alias("_n"), F.min("cid").alias("_c"), *[F.min(F.struct(F.xxhash64("cid", F.lit(s)), "cid")).alias(f"_c{s}") for s in (1, 2, 3)])
    totals = cut(sums.groupBy("component").agg(
        F.sum("_n").alias("_total"), F.max("_n").alias("_most"), F.array(F.min("_c"), *[F.min(f"_c{s}")["cid"] for s in (1, 2, 3)]).alias("_common")))
    zero, large = F.lit(0).cast("long"), F.col("_total") > TASK_SHINGLES
    chunks = F.when(large, F.ceil(F.col("_total") / TASK_SHINGLES)).otherwise(1).cast("long")
    part = F.when(F.array_contains("_common", F.col("cid")), F.sequence(zero, F.col("_chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid", F.lit(5)), F.col("_chunks"))))
    first = members.join(totals.filter(~large | (F.col("_most") * 2 <= F.col("_total"))), "component").withColumn("_chunks", chunks).withColumn("part", F.explode(part))
    classes = relabelled(classes, cut(confirmed_links(docs, first, words, percent)))
    hot = totals.filter(large).select("component")
    if not hot.isEmpty():
        rest = members.select("component", "cid").join(hot, "component", "left_semi").join(classes.select("cid", "label", "n", "rep", "th", "digest"), "cid")
        classes = relabelled(classes, cut(confirmed_links(docs, dealt(rest.select(*inside), "component", F.col("n"), TASK_SHINGLES), words, percent)))
    return classes.select(*keep)


def resolved(docs: DataFrame, words: int, percent: int, trees: int) -> DataFrame:
    """doc_id, th, n, component per document, and the smallest (doc_id, th) of the component as `first`; both null without a doc_id or words."""
    signed = cut(signed_sets(docs, words))
    row = F.struct(F.col("doc_id").alias("rep"), "th")
    classes = signed.filter("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min(row).alias("row"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("bits_a").alias("bits_a"), F.first("bits_b").alias("bits_b"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()).select("cid", F.col("cid").alias("label"), "row.rep", "row.th", "digest", "n", "tokens", "bits_a", "bits_b"))
    named = merged(docs, classes, hub_links(classes), words, percent)
    named = merged(docs, named, candidate_links(named, trees), words, percent)
    least = cut(named.groupBy("label").agg(F.min(F.struct("rep", "th")).alias("first")))
    final = named.select("digest", "label").join(least, "label").select(F.col("digest").alias("_digest"), "first")
    out = signed.select("doc_id", "th", "n", "digest").join(final, F.col("digest") == F.col("_digest"), "left")
    return out.select("doc_id", "th", "n", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), kept (doc_id = component_id).

    Documents link when 100 * intersection >= percent * union of their sets of `words`-word shingles; a text with fewer words is one shingle, one without
    words (or null) has an empty set and links with nothing. A null doc_id links with nothing (component null, kept false); repeated rows of an id
    give repeated rows, each judged by its own text. An empty table gives no row.
    """
    component = F.coalesce(F.col("first.rep"), F.col("doc_id"))
    return resolved(docs, words, percent, trees).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns kept, with one row of each group: the one with the smallest doc_id, of several texts of that id the one with the smallest hash. Rows with a
    null id and texts without words link with nothing and stay; of rows equal in id and text one stays (the one with the smallest hash of all columns)."""
    key = [F.col("doc_id").cast("long").alias("_near_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_near_th")]
    rows = cut(resolved(docs, words, percent, TREES).filter("doc_id is not null").groupBy("doc_id", "th").agg(F.first("first").alias("first"), F.count("*").alias("times")))
    gone = rows.filter((F.col("first.rep") != F.col("doc_id")) | (F.col("first.th") != F.col("th"))).select("doc_id", "th")
    twice = rows.filter("times > 1").select("doc_id", "th")
    at = lambda some, how: left.join(some.select(F.col("doc_id").alias("_some_id"), F.col("th").alias("_some_th")), (F.col("_near_id") == F.col("_some_id")) & (F.col("_near_th") == F.col("_some_th")), how)
    left = docs.select("*", *key)
    left = at(gone, "left_anti")
    if twice.isEmpty():
        return left.select(*docs.columns)
    whole = F.struct(*docs.columns)
    again = at(twice, "left_semi").groupBy("_near_id", "_near_th").agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return at(twice, "left_anti").select(*docs.columns).union(again)
