"""Multi-party perspective rotation: each dialogue once per participant, with that speaker as the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 256


def rotate(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per (dialogue, participant, turn): the rendered segment, its place in that participant's rendering, and its loss mask.

    Columns: conv_id, perspective, turn, speaker, segment, start, end, mask_start, mask_end. Characters [start, end) of the
    rendering (all segments of a perspective in order, joined) are this segment; [mask_start, mask_end) of them are trained on: the
    perspective's own words and end marker; both equal `end` for other speakers. Others are users with their name in the header; 'system' turns
    keep their role and are no participant, so a dialogue of system turns alone has no rendering.

    A null role is the speaker 'unknown', a null text is empty, a null conv_id or turn is a value of its own (nulls first); repeated rows are
    repeated segments, ties of a turn are ordered by speaker and text. Long dialogues are cut into blocks of turns: one task orders a block, and
    block totals (from lengths alone) give the offsets, so a dialogue with a third of all turns is spread over tasks and texts are shuffled once.
    """
    rows = turns.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.floor(F.coalesce(F.col("turn"), F.lit(0)) / block).cast("long").alias("_block"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("_key"),
    )

    def header():
        own = F.col("speaker") == F.col("perspective")
        role = F.when(own, F.lit("assistant")).when(F.col("speaker") == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
        return F.concat(F.lit(START), role, F.lit("\n"))

    closing = END + "\n"
    sizes = rows.groupBy("_key", "_block", "speaker").agg(F.sum(F.length("_text").cast("long")).alias("_chars"), F.count("*").alias("_turns"))
    people = sizes.filter("speaker != 'system'").select("_key", F.col("speaker").alias("perspective")).distinct()
    seen = sizes.join(people, "_key")
    totals = seen.groupBy("_key", "_block", "perspective").agg(F.sum(F.col("_chars") + F.col("_turns") * (F.length(header()) + len(closing))).alias("_total"))
    before = W.partitionBy("_key", "perspective").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_key", "_block", "perspective", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    # the one shuffle of the texts, by (dialogue, block); the window below keeps it
    placed = rows.join(offsets, ["_key", "_block"]).withColumn("_head", header()).withColumn("segment", F.concat("_head", "_text", F.lit(closing)))
    inside = W.partitionBy("_key", "_block", "perspective").orderBy("turn", "speaker", "_text").rowsBetween(W.unboundedPreceding, -1)
    own, size = F.col("speaker") == F.col("perspective"), F.length("segment").cast("long")
    start = (F.coalesce(F.sum(size).over(inside), F.lit(0)) + F.col("_base")).cast("long")
    placed = placed.withColumn("start", start)
    end = F.col("start") + size
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "segment", "start", end.alias("end"),
        F.when(own, F.col("start") + F.length("_head")).otherwise(end).alias("mask_start"), F.when(own, end - 1).otherwise(end).alias("mask_end"),
    )


def oracle() -> str:
    """Plain window form for DuckDB."""
    return f"""
with r as (select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as t from conversations),
p as (select distinct conv_id, speaker as perspective from r where speaker <> 'system'),
s as (select r.*, perspective, '{START}' || case when speaker = perspective then 'assistant' when speaker = 'system' then 'system' else 'user name=' || speaker end || chr(10) as head
      from r join p on r.conv_id is not distinct from p.conv_id),
g as (select *, head || t || '{END}' || chr(10) as segment from s),
o as (select *, sum(length(segment)) over (partition by conv_id, perspective order by turn nulls first, speaker, t rows between unbounded preceding and current row) as stop from g)
select conv_id, perspective, turn, speaker, segment, cast(stop - length(segment) as bigint) as "start", cast(stop as bigint) as "end",
       cast(case when speaker = perspective then stop - length(segment) + length(head) else stop end as bigint) as mask_start,
       cast(case when speaker = perspective then stop - 1 else stop end as bigint) as mask_end from o"""
