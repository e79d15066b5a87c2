"""Registered queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, cws, nearjoin, packing, passages, perspectives, secretscan, toxicity, trie, unigram_counts, urlrules, vectorcodes, wfst
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file: the folder named by TOKENIZER_DIR, else the installed package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_multiprobe_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op3_near_duplicates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(read(spark, sf_dir, "documents"), words=2)


@query("op4_sentencepiece_transducer")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.audit(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op5_url_rules", urlrules.oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(read(spark, sf_dir, "pages"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op8_perspectives", perspectives.oracle())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(read(spark, sf_dir, "conversations"))


@query("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.compare(read(spark, sf_dir, "documents"))


@query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(read(spark, sf_dir, "documents"))


@query("op11_prefix_trie", trie.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(read(spark, sf_dir, "conversations"))


@query("op12_vector_codes", vectorcodes.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.encode(read(spark, sf_dir, "embeddings"))


@query("op13_passage_quality")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
