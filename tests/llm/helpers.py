"""Rows that every operator must take: nulls, empty and very long texts, repeated rows, clashing column names."""

from __future__ import annotations

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("_k", "_words", "key", "n", "rep", "score", "kept", "start", "component", "spans", "host", "block", "ids", "label", "h", "w", "p", "_rule_key", "_dup_key", "_pii_key", "_pii_spans")


def edge_rows():
    prose = " ".join(f"word{i % 97}x{i % 13}" for i in range(80))
    return [
        (1, prose, "en", "s1", 1),
        (1, prose, "en", "s1", 1),  # a repeated row
        (2, None, "en", "s1", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "en", "s2", 4),
        (None, prose + " tail", "en", None, 9),
        (5, "one", None, "s2", 3),
        (6, "long " * 30_000 + "end", "en", "s1", 150_003),
        (7, "x" * 60_000, "en", "s1", 60_000),
        (8, "Éa ñ 日本語 🙂 \u0085 \x00 \x01 \x02 <|endoftext|> tail", "xx", "s3", 40),
    ]


def edge_docs(spark):
    df = spark.createDataFrame(edge_rows(), DOCS)
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASH})


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]
