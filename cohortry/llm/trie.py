"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

1. Turns are numbered inside their conversation over ranges of the global order, so one conversation with a third of all turns is spread over tasks.
2. The prefix of d turns is named by the XOR of d 128-bit hashes of (place, role, text): a running XOR inside blocks of places, with block totals scanned the same way.
   Equal names are one node; texts are hashed where they are read and never shuffled.
3. Every node belongs to its smallest member, and what a conversation owns is a run of its depths down to its end. So the total of a subtree is, summed over the members
   of its top, what each of them owns from that depth on: a running sum from the end of every conversation (in blocks, as above) and one sum per node. The number of jobs
   does not follow the depth or the shape of the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Conversations of a hundred share the opening of the one with the smallest number of that hundred; at most five turns of it.
FAMILY, OPENING = 100, 5
#: Places that one window of the running XOR holds; ids that one text chunk of an end list holds.
BLOCK, CHUNK = 4096, 8192
NODE = ["depth", "k1", "k2"]


def opening_length(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string")), F.lit(OPENING + 1)).cast("long")


def _width(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, places): rows (conv, _part, seq, h1, h2, chars) and, per (conv, _part), the number of turns before that part and in the whole conversation.
    A turn's index is seq + before. Order: turn (null first), role, md5 of the text; repeated turns are counted before they are ordered."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    hashed = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), F.md5(text).alias("md5"), F.length(text).cast("long").alias("chars"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role).alias("h2"))
    order = ["conv", "turn", "role", "md5"]
    once = hashed.groupBy(*order, "chars", "h1", "h2").agg(F.count("*").alias("times"))
    rows = cut(once.repartitionByRange(_width(turns), *order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("conv", "_part").orderBy(*order[1:]).rowsBetween(W.unboundedPreceding, -1)
    seq = rows.withColumn("_before", F.coalesce(F.sum("times").over(inside), F.lit(0)))
    seq = seq.select("conv", "_part", "h1", "h2", "chars", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("times"))).alias("seq"))
    parts = rows.groupBy("conv", "_part").agg(F.sum("times").alias("n"))
    whole = W.partitionBy("conv")
    before = F.coalesce(F.sum("n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return seq, parts.select("conv", "_part", before.alias("before"), F.sum("n").over(whole).alias("own"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, convs): rows (conv, depth, h1, h2, chars) of every rebuilt conversation, and convs (conv, length); lengths may be 0."""
    rows, places = numbered(turns)
    places = cut(places)
    convs = places.groupBy("conv").agg(F.max("own").alias("own")).withColumn("opening", opening_length(F.col("conv"))).withColumn("head", F.col("conv") - F.col("conv") % FAMILY)
    heads = convs.filter(F.col("conv") == F.col("head")).select("head", F.col("own").alias("head_own"))
    shared = F.least("opening", F.coalesce("head_own", F.lit(0)))
    convs = cut(convs.join(heads, "head", "left").select(
        "conv", "head", "opening", shared.alias("shared"), (shared + F.greatest(F.col("own") - F.col("opening"), F.lit(0))).alias("length")))
    at = places.join(convs.select("conv", "opening", "shared"), "conv").select("conv", "_part", "before", "opening", "shared")
    mine = cut(rows.join(at, ["conv", "_part"]).select("conv", (F.col("seq") + F.col("before")).alias("index"), "opening", "shared", "h1", "h2", "chars"))
    first = mine.filter((F.col("index") <= OPENING) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("head"), F.col("index").alias("depth"), "h1", "h2", "chars")
    lent = convs.select("conv", "head", "shared").join(first, "head").filter("depth <= shared").select("conv", "depth", "h1", "h2", "chars")
    kept = mine.filter(F.col("index") > F.col("opening")).select("conv", (F.col("index") - F.col("opening") + F.col("shared")).alias("depth"), "h1", "h2", "chars")
    return lent.union(kept), convs.select("conv", "length")


def running_xor(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Columns k1, k2: the XOR of x1, x2 over depths 1 .. depth of the conversation. Blocks of depths are scanned alone; their totals by the same function."""
    rows = rows.withColumn("_block", F.floor((F.col("depth") - 1) / block).cast("long"))
    inside = W.partitionBy("conv", "_block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("k1", F.bit_xor("x1").over(inside)).withColumn("k2", F.bit_xor("x2").over(inside))
    if (rows.agg(F.max("_block")).first()[0] or 0) == 0:
        return out.drop("_block")
    totals = rows.groupBy("conv", (F.col("_block") + 1).alias("depth")).agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    above = running_xor(cut(totals), block).select("conv", F.col("depth").alias("_block"), F.col("k1").alias("_a1"), F.col("k2").alias("_a2"))
    out = out.join(above, ["conv", "_block"], "left")
    return out.withColumn("k1", F.col("k1").bitwiseXOR(F.coalesce("_a1", F.lit(0)))).withColumn("k2", F.col("k2").bitwiseXOR(F.coalesce("_a2", F.lit(0)))).drop("_block", "_a1", "_a2")


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per (conversation, depth from 0): conv, depth, k1, k2 (name of the node), p1, p2 (name of its parent), chars, ends (the conversation ends here)."""
    rows, convs = rebuilt(turns)
    rows = cut(rows.select("conv", "depth", "chars", *[F.xxhash64(F.lit(s), "depth", "h1", "h2").alias(f"x{s}") for s in (1, 2)]))
    named = running_xor(rows, block).select(
        "conv", "depth", "k1", "k2", *[F.col(f"k{s}").bitwiseXOR(F.col(f"x{s}")).alias(f"p{s}") for s in (1, 2)], "chars")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("chars"))
    length = convs.select(F.col("conv").alias("_conv"), F.col("length").alias("_depth"), F.lit(True).alias("_end"))
    every = named.union(root)
    return every.join(length, (F.col("conv") == F.col("_conv")) & (F.col("depth") == F.col("_depth")), "left").select(*every.columns, F.coalesce("_end", F.lit(False)).alias("ends"))


def _order(conv: str, depth: str) -> tuple[Column, Column]:
    """Place of a node in the order of the round in column `turn`: (leading key, tie); lower goes first."""
    c, d = F.col(conv), F.col(depth)
    lowest_bit = F.when(d == 0, F.lit(2**62)).otherwise(d.bitwiseAND(-d))
    return F.when(F.col("turn") % 2 == 1, lowest_bit).otherwise(F.lit(0)), F.xxhash64("turn", c, d)


def _before(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] < b[1]))


def subtree_sums(nodes: DataFrame, values: list[str], rounds: int = 400) -> DataFrame:
    """For a tree (conv, depth) with parent (up_conv, depth - 1; root: null) and n_children: (conv, depth) and the sum of each value over the subtree, top included.
    For trees of which no more is known than the parents; the trie itself takes `member_sums`.

    Contraction in join rounds: each rakes all leaves into their parents (a sum per parent) and compresses unary chains: a node with one child leaves the chain if it
    comes before both neighbours in the round's order, and its child inherits its parent and what lay above. Odd rounds order by the lowest set bit of the depth (an
    untouched chain halves), even rounds by a hash. Then a compressed node's total is its child's plus what it recorded; the references are doubled until they reach raked nodes.

    `live` holds what is left of the tree: a_v is a node's value with all that was raked into it, e_v what was compressed out of the edge above it. Every round is
    one sum per parent and two joins on the node; live nodes shrink by a constant share, so all rounds together move a few times the first one. The number of the
    round is a column, so every round runs the same generated code.
    """
    live = nodes.select(
        "conv", "depth", F.col("up_conv"), F.when(F.col("up_conv").isNotNull(), F.col("depth") - 1).alias("up_depth"), F.col("n_children").alias("kids"),
        *[F.col(v).cast("long").alias(f"a_{v}") for v in values], *[F.lit(0).cast("long").alias(f"e_{v}") for v in values], F.lit(1).cast("long").alias("turn"))
    live = cut(live)
    leaf, inner = F.col("kids") == 0, F.col("kids") > 0
    raked, dropped, turn = [], [], 0
    while True:
        below = live.filter("up_conv is not null")
        if below.isEmpty():
            break
        turn += 1
        if turn > rounds:
            raise RuntimeError(f"the tree did not contract in {rounds} rounds")
        sums = below.groupBy(F.col("up_conv").alias("_c"), F.col("up_depth").alias("_d")).agg(
            F.sum(leaf.cast("long")).alias("_raked"), F.max(F.when(inner, F.col("conv"))).alias("child_conv"), F.max(F.when(inner, F.col("depth"))).alias("child_depth"),
            *[F.sum(F.when(leaf, F.col(f"a_{v}") + F.col(f"e_{v}")).otherwise(0)).alias(f"_s_{v}") for v in values],
            *[F.max(F.when(inner, F.col(f"e_{v}"))).alias(f"_e_{v}") for v in values])
        raked.append(below.filter(leaf).select("conv", "depth", *[F.col(f"a_{v}").alias(v) for v in values]))
        stay = live.filter(inner | F.col("up_conv").isNull()).join(sums, (F.col("conv") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
        kids = F.col("kids") - F.coalesce("_raked", F.lit(0))
        me = _order("conv", "depth")
        goes = (kids == 1) & F.col("up_conv").isNotNull() & _before(me, _order("up_conv", "up_depth")) & _before(me, _order("child_conv", "child_depth"))
        stay = cut(stay.select(
            "conv", "depth", "up_conv", "up_depth", kids.alias("kids"), *[(F.col(f"a_{v}") + F.coalesce(f"_s_{v}", F.lit(0))).alias(f"a_{v}") for v in values],
            *[f"e_{v}" for v in values], F.coalesce(goes, F.lit(False)).alias("goes"), "child_conv", "child_depth", *[f"_e_{v}" for v in values], "turn"))
        gone = stay.filter("goes")
        dropped.append(gone.select("conv", "depth", "child_conv", "child_depth", *[(F.col(f"a_{v}") + F.col(f"_e_{v}")).alias(v) for v in values]))
        word = gone.select(F.col("child_conv").alias("_c"), F.col("child_depth").alias("_d"), F.col("up_conv").alias("_up_conv"), F.col("up_depth").alias("_up_depth"),
                           *[(F.col(f"e_{v}") + F.col(f"a_{v}")).alias(f"_m_{v}") for v in values])
        rest = stay.filter("not goes").join(word, (F.col("conv") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
        live = cut(rest.select("conv", "depth", F.coalesce("_up_conv", "up_conv").alias("up_conv"), F.coalesce("_up_depth", "up_depth").alias("up_depth"), "kids",
                               *[f"a_{v}" for v in values], *[(F.col(f"e_{v}") + F.coalesce(f"_m_{v}", F.lit(0))).alias(f"e_{v}") for v in values], (F.col("turn") + 1).alias("turn")))
    known = live.select("conv", "depth", *[F.col(f"a_{v}").alias(v) for v in values])
    for some in raked:
        known = known.union(some)
    if not dropped:
        return known
    refs = dropped[0]
    for some in dropped[1:]:
        refs = refs.union(some)
    hop = lambda t, at: t.select(*[F.col(c).alias(f"_{c}") for c in t.columns]).withColumnsRenamed({"_conv": "_c", "_depth": "_d"})
    to = (F.col("child_conv") == F.col("_c")) & (F.col("child_depth") == F.col("_d"))
    refs = cut(refs)
    for _ in range(max(0, turn - 1).bit_length()):
        refs = refs.join(hop(refs, "refs"), to, "left").select(
            "conv", "depth", F.coalesce("_child_conv", "child_conv").alias("child_conv"), F.coalesce("_child_depth", "child_depth").alias("child_depth"),
            *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        refs = cut(refs)
    known = cut(known)
    found = refs.join(hop(known, "known"), to).select("conv", "depth", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])
    return known.union(found)


def end_digests(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2) -> SHA-256 of the comma-joined decimal `conv` of its rows in ascending order. Ranges of the order write chunks of text; what hashes a node
    reads its chunks as a stream and holds one of them."""
    width = _width(rows)

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            new = (frame[NODE] != frame[NODE].shift()).any(axis=1).to_numpy()
            new[0] = True
            starts = new.nonzero()[0].tolist()
            cuts = [k for a, b in zip(starts, [*starts[1:], len(frame)], strict=True) for k in range(a, b, CHUNK)]
            texts = frame["conv"].astype(str).tolist()
            out = frame.iloc[cuts].copy()
            out["ids"] = [",".join(texts[a:b]) for a, b in zip(cuts, [*cuts[1:], len(frame)], strict=True)]
            yield out

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            done = []
            for *node, ids in zip(*(frame[c].tolist() for c in [*NODE, "ids"]), strict=True):
                if node == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    keys = [*NODE, "conv"]
    parts = rows.select(*keys).repartitionByRange(width, *keys).sortWithinPartitions(*keys).mapInPandas(chunks, "depth long, k1 long, k2 long, conv long, ids string")
    return parts.repartition(width, *NODE).sortWithinPartitions(*keys).select(*NODE, "ids").mapInPandas(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def from_here_on(rows: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """Each value replaced by its sum over the rows of the conversation at this depth or deeper. Depths may repeat, blocks of them follow without a gap."""
    keep = rows.columns
    rows = rows.withColumn("_block", F.floor(F.col("depth") / block).cast("long"))
    inside = W.partitionBy("conv", "_block").orderBy(F.desc("depth")).rangeBetween(W.unboundedPreceding, W.currentRow)
    out = rows.select(*[c for c in rows.columns if c not in values], *[F.sum(v).over(inside).alias(v) for v in values])
    if (rows.agg(F.max("_block")).first()[0] or 0) == 0:
        return out.select(*keep)
    totals = rows.groupBy("conv", F.col("_block").alias("depth")).agg(*[F.sum(v).alias(v) for v in values])
    after = from_here_on(cut(totals), values, block).select("conv", (F.col("depth") - 1).alias("_block"), *[F.col(v).alias(f"_after_{v}") for v in values])
    return out.join(after, ["conv", "_block"], "left").select(*[(F.col(c) + F.coalesce(f"_after_{c}", F.lit(0))).alias(c) if c in values else F.col(c) for c in keep])


def member_sums(rows: DataFrame, nodes: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """Sum of each value over the subtree of a node, top included: NODE and the values. rows: (conv, NODE) per conversation and depth; nodes: conv, depth and values of the
    nodes, each at its smallest member."""
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    every = rows.select("conv", *NODE, *[zero.alias(v) for v in values]).union(nodes.select("conv", "depth", none.alias("k1"), none.alias("k2"), *values))
    return from_here_on(every, values, block).filter("k1 is not null").groupBy(*NODE).agg(*[F.sum(v).alias(v) for v in values])


def trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c is rebuilt as the first h turns of conversation c - c % 100 followed by its own turns after its first h, h = crc32(decimal c) % 6. A null role or
    text is empty; a null turn comes first; turns that tie are ordered by role, then by the md5 of the text; repeated rows are repeated turns. Rows with a null conv_id
    belong to no conversation and take no part. A conversation that is rebuilt without turns is a member of the root alone. An empty table has no conversation and
    no node. Other columns are ignored.
    """
    rows = cut(prefixes(turns, block))
    nodes = cut(rows.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2")))
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(kids, NODE, "left").fillna(0, ["n_children"]))
    above = nodes.select(F.col("depth").alias("_d"), F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.col("conv").alias("up_conv"))
    nodes = nodes.join(above, (F.col("depth") - 1 == F.col("_d")) & (F.col("p1") == F.col("_1")) & (F.col("p2") == F.col("_2")), "left").select(
        *NODE, "conv", "up_conv", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    nodes = cut(nodes)
    totals = member_sums(rows, nodes, ["n_leaves", "saved_tokens"], block)
    ends = end_digests(rows.filter("ends"))
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, NODE).join(ends, NODE, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def oracle() -> str:
    """DuckDB: node names are running lists of md5 values; subtree sums by joining every node with the conversation of each node below it."""
    return f"""
with recursive table_bits as (
  select n, n as v, 0 as k from range(256) t(n)
  union all select n, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from table_bits where k < 8),
crc as (select list(v order by n) as t from table_bits where k = 8),
own as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as i,
               md5(coalesce(role, '') || chr(1) || coalesce(text, '')) as m, length(coalesce(text, '')) as chars
        from conversations where conv_id is not null),
ids as (select distinct c, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))),
          lambda a, b: xor(a >> 8, t[cast(xor(a, b) & 255 as integer) + 1]))) % {OPENING + 1} as h from own, crc),
lent as (select ids.c, i as depth, m, chars from ids join own on own.c = ids.c - ids.c % {FAMILY} and i <= h),
n_lent as (select c, count(*) as n from lent group by c),
kept as (select own.c, own.i - h + coalesce(n, 0) as depth, m, chars from own join ids on ids.c = own.c left join n_lent on n_lent.c = own.c where own.i > h),
turns as (select * from lent union all select * from kept),
pref as (select c, depth, md5(string_agg(m, ',') over (partition by c order by depth rows between unbounded preceding and current row)) as k, chars from turns
         union all select c, 0, '', 0 from ids),
ends as (select c, max(depth) as depth from pref group by c),
node as (select depth, k, min(c) as conv_id, count(*) as n_convs, max(chars) as chars from pref group by all),
up as (select a.depth, a.k, min(b.k) as parent_k from pref a join pref b on a.c = b.c and b.depth = a.depth - 1 group by all),
tree as (select node.*, p.conv_id as parent_conv_id, coalesce(kids.n, 0) as n_children
         from node left join up using (depth, k) left join node p on p.depth = node.depth - 1 and p.k = up.parent_k
         left join (select depth - 1 as depth, parent_k as k, count(*) as n from up group by all) kids on kids.depth = node.depth and kids.k = node.k),
sums as (select a.depth, a.k, sum(case when t.n_children = 0 then 1 else 0 end) as n_leaves, sum((t.n_convs - 1) * t.chars) as saved_tokens
         from tree t join pref a on a.c = t.conv_id and a.depth <= t.depth group by all),
texts as (select p.depth, p.k, string_agg(cast(p.c as varchar), ',' order by p.c) as s from pref p join ends e on e.c = p.c and e.depth = p.depth group by all)
select conv_id, cast(depth as bigint) as depth, parent_conv_id, n_convs, cast(n_children as bigint) as n_children, cast(n_leaves as bigint) as n_leaves,
       cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(s, '')) as ends_sha256
from tree join sums using (depth, k) left join texts using (depth, k)"""
