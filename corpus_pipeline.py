"""The training-data pipeline: quality classifier, quality rules, near-duplicates, personal data, packing.

``STAGES`` lists (name, function).  A function takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of ``docs``, of the
documents that stay.  ``run`` writes each stage's result as Parquet under the
checkpoint folder and reads it again for the next one.

Defined results: a document with a null or empty text fails the base rules and
goes; of rows that repeat a doc_id and text one stays, rows that share only the
doc_id are judged each by its own text; rows with a null doc_id are
linked with nothing and stay; further columns, whatever their names, are
carried along; ties don't matter, since every stage decides by key; texts of any
length are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import crf, neardup, packing, pii, rules
from spindle.llm.common import free_name, read_table, row_key, written
from spindle.session import prepare


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's limit."""
    prepare(spark)
    theta = crf.train(docs, read_table(spark, sf_dir, "labels"))
    return crf.good_documents(docs, theta)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their host's verdicts."""
    prepare(spark)
    key = free_name(docs, "_rule_key")
    rejected = rules.quality_rules(docs).where(~F.col("kept")).select(F.col("_k").alias(key)).distinct()
    return row_key(docs, key=key).join(rejected, key, "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    prepare(spark)
    key = free_name(docs, "_dup_key")
    keyed = row_key(docs, key=key)
    stay = neardup.near_duplicates(keyed.select("doc_id", "text", key), (key,), one_node=False).where("kept").select(key).distinct()
    known = keyed.join(stay, key, "left_semi").dropDuplicates([key])
    return known.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    prepare(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    import public_tokenizers

    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: The classifier's scores, the boosted trees and the tokenizer can't be written in SQL; tests compare the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
