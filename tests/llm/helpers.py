"""Shared small tables of the operator tests."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
CLASH = ", cast(1 as int) as score, 'x' as digest, 2 as n, 'y' as slot, 3 as node, 'z' as component, 4 as _token, 'w' as rule, 5 as part, 6 as length, 7 as piece"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    """Null id, null text, empty, blank, one word, very long, repeated rows, ties, and extra columns with the names that operators use."""
    long = " ".join(f"word{i % 977} tail{i}" for i in range(40_000))
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, "   \t\n ", "en", None, 5), (4, "Single", "en", "a", 6), (5, "alpha beta gamma delta epsilon", "en", "a", 30),
        (6, "alpha beta gamma delta epsilon", "de", "b", 30), (7, long, "en", "a", len(long)), (8, "Ünïcode ﬁ ① 梦 \U0001f600 e\u0301 naïve Σας", "fr", "c", 30),
        (8, "Ünïcode ﬁ ① 梦 \U0001f600 e\u0301 naïve Σας", "fr", "c", 30), (None, "text of a row without id", "en", "a", 24), (10, "x" * 5000, "en", "a", 5000),
        (11, "don't STOP we'll 12ab34 <|endoftext|> !!?? a'b", "en", "a", 40),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", *CLASH[2:].split(", "))


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
