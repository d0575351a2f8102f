"""Structured Streaming adapter.

The reference has no streams; the operators are plain DataFrame functions,
so they apply unchanged to a ``readStream`` source.  This module wires the
token-frequency aggregate (#37) to a parquet folder stream with a reliable
checkpoint location under the session's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.io import scratch_path

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def document_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming DataFrame over parquet files of documents arriving in ``folder``."""
    return spark.readStream.schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder)


def streaming_token_counts(docs: DataFrame) -> DataFrame:
    """Running word counts of a document stream (stateful aggregation)."""
    return docs.select(F.explode(T.word_tokens("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def run_to_memory(spark: SparkSession, stream: DataFrame, name: str):
    """Start a complete-mode query into an in-memory table and drain the input."""
    q = (
        stream.writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", scratch_path(spark, f"stream-{name}"))
        .start()
    )
    q.processAllAvailable()
    return q
