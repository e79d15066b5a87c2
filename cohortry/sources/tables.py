"""Scans, sinks and incremental bookkeeping (S rows)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.hashing import h60
from ..functions.numeric import n_if
from ..operators.ordered import attach_one, bucketed_prefix, value_buckets, BUCKET


def load_clean_csv(spark: SparkSession, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    """S1. Every cell as text, trimmed, empty -> NULL; no type inference (so no extra pass over the file)."""
    reader = spark.read.option("header", True).option("inferSchema", False)
    if cols:
        reader = reader.schema(", ".join(f"`{c}` string" for c in cols))
    df = reader.csv(path)
    return df.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in df.columns])


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def csv_guards(df: DataFrame, key: str, key_regex: str, domains: dict[str, Sequence[str]]) -> DataFrame:
    """S1 guards as rows (check, n): NULL key, malformed key, repeated key, values outside a closed domain."""
    k = F.col(key)
    aggs = [n_if(k.isNull()).alias("key_null"), n_if(k.isNotNull() & ~k.rlike(key_regex)).alias("key_format")]
    aggs += [n_if(F.col(c).isNotNull() & ~F.col(c).isin(list(v))).alias(f"domain_{c}") for c, v in domains.items()]
    one = df.agg(*aggs)
    rows = one.unpivot([], one.columns, "check", "n")
    dup = df.filter(k.isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.lit("key_repeated").alias("check"), n_if(F.col("c") > 1).alias("n"))
    return rows.unionByName(dup)


@F.pandas_udf(StringType())
def file_sha256(path: pd.Series) -> pd.Series:
    """SHA-256 of each file:/ path, read in blocks by the task that holds the row."""

    def digest(p: str) -> str:
        with open(re.sub("^file:/+", "/", p), "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    return path.map(digest)


def scan_inventory(spark: SparkSession, root: str, exts: Sequence[str]) -> DataFrame:
    """S2. Recursive file listing with size, extension class and content digest; hidden files are skipped by Spark.

    Files that tasks can open are digested as streams, so a file of any size takes one block of memory. In a store that only Spark's readers
    reach, a file comes as one row (at most 2 GB).
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    sha256 = file_sha256("path") if all(p.startswith("file:/") for p in f.inputFiles()) else F.sha2("content", 256)
    return f.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), ext.alias("ext"), F.when(ext.isin(list(exts)), "media").otherwise("other").alias("kind"),
                    F.col("length").alias("size"), sha256.alias("sha256"))


def source_version(expected: DataFrame, inventory: DataFrame, path: str, digest: str) -> DataFrame:
    """S3. State of every expected file: ok / missing / changed."""
    inv = inventory.select(path, F.col(digest).alias("_found"))
    state = F.when(F.col("_found").isNull(), "missing").when(F.col("_found") != F.col(digest), "changed").otherwise("ok")
    return expected.join(inv, path, "left").select(path, state.alias("state"))


def write_shards(df: DataFrame, path: str, signature: str, row: str, shards: int) -> None:
    """S4 input side: shards partitioned by number, each row carrying the run signature. The committer makes the write atomic."""
    df.withColumns({"signature": F.lit(signature), "shard": (F.col(row) % shards).cast("int")}).repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shard_guards(df: DataFrame, row: str) -> DataFrame:
    """S4. One signature; rows cover 0..n-1 exactly once (count = distinct = max+1 and min = 0)."""
    per = df.groupBy(row).agg(F.count(F.lit(1)).alias("c"), F.min("signature").alias("s0"), F.max("signature").alias("s1"))
    g = per.agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.count(F.lit(1)).alias("d"), F.sum("c").alias("n"), F.min(row).alias("lo"), F.max(row).alias("hi"))
    return g.select(F.col("n").cast("long").alias("n_rows"), (F.col("s0") == F.col("s1")).alias("one_signature"),
                    ((F.col("n") == F.col("d")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("rows_complete"))


def write_deterministic(df: DataFrame, path: str, order: Sequence[str], float_fmt: str = "%.6f", parts: int = 8) -> None:
    """S5. Sorted text output: range-partitioned by the sort key (parallel, globally ordered), fixed float format, \\n endings."""
    cols = [F.format_string(float_fmt, F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*cols).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """S5. Size and digest of every written part."""
    return scan_inventory(spark, path, ["csv", "parquet"]).select("name", "size", "sha256")


def upsert_registry(registry: DataFrame, new: DataFrame, key: str = "experiment_id") -> DataFrame:
    """S6. Old rows of the new experiments are dropped; columns are aligned."""
    kept = registry.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def write_registry(df: DataFrame, path: str, key: str = "experiment_id") -> None:
    """S6 on disk: replaces only the partitions of the experiments present in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def pending_units(plan: DataFrame, done: DataFrame, unit: Sequence[str], signature: str = "signature") -> DataFrame:
    """S7. Planned units without a stored result of the same signature."""
    return plan.join(done.select(*unit, signature), [*unit, signature], "left_anti")


def consistent_signatures(stored: DataFrame, arm: str, repeat: str, planned: int, signature: str = "signature") -> DataFrame:
    """S8. Per arm: different signatures, repeats found, ok flag."""
    g = stored.groupBy(arm).agg(F.countDistinct(signature).cast("long").alias("n_signatures"), F.countDistinct(repeat).cast("long").alias("n_repeats"))
    return g.withColumn("ok", (F.col("n_signatures") == 1) & (F.col("n_repeats") == planned))


def row_text(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in (cols or df.columns)])


def table_digest(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """S9. Order-free content fingerprint: row count and the sums (decimals, as text) of two independent 60-bit hashes of every row."""
    t = df.select(row_text(df, cols).alias("_r"))
    return t.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.sum(h60("_r").cast("decimal(20,0)")).cast("string").alias("digest_a"), F.sum(h60("_r", F.lit("b")).cast("decimal(20,0)")).cast("string").alias("digest_b"))


def build_offsets(df: DataFrame, order: str, length: str) -> DataFrame:
    """S10. Offset = sum of earlier lengths, in key order, without a one-task window."""
    return bucketed_prefix(value_buckets(df, order, measures=[length]), [], [order], {"offset": F.col(length)}).drop(BUCKET)


def offset_guard(idx: DataFrame, length: str) -> DataFrame:
    """S10. Contiguity without ordering rows: every end is another row's offset or the total (hash join on the value)."""
    ends = idx.filter(F.col(length) > 0).select((F.col("offset") + F.col(length)).alias("offset"))
    tot = idx.agg(F.sum(length).alias("total"), F.max(F.col("offset") + F.col(length)).alias("last_end"), F.min("offset").alias("first"))
    gaps = ends.join(idx.filter(F.col(length) > 0).select("offset"), "offset", "left_anti").agg(F.count(F.lit(1)).cast("long").alias("open_ends"))
    return attach_one(tot, gaps).select(F.col("total").cast("long").alias("total"), ((F.col("open_ends") == 1) & (F.col("first") == 0) & (F.col("last_end") == F.col("total"))).alias("contiguous"))


def read_summary(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S11. Stored nested JSON result."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def summary_rows(df: DataFrame, c: str) -> DataFrame:
    """S11. Array of result structs -> one row each."""
    return df.select(F.inline(F.col(c)))
