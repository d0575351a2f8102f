"""Driver tables and the stand-in views the operators run on (FIXTURES.md §3).

Every view is a lazy DataFrame derived from the given parquet tables, so the
work of every query grows with the input.  Only the columns a query needs
reach the parquet scan (Catalyst prunes the rest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


TEXT_TABLES = {"documents", "conversations", "pages", "benchmark"}


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that is narrower than the cluster (e.g. one parquet row
    group) before per-row text work.  On large inputs the scan already has
    more splits than cores and nothing is added."""
    sc = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() < sc.defaultParallelism:
        return df.repartition(sc.defaultParallelism)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus(id, text)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labelled(id, text, toxic, quality, source, lang) = documents ⋈ labels."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", "source", "lang"
    )
    labs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic", "quality")
    return docs.join(labs, "id", "inner")


def tokens(df: DataFrame, text_col: str = "text", id_col: str = "id", words_only: bool = False) -> DataFrame:
    """tokens(id, pos, token): one row per token, 0-based position."""
    arr = T.word_tokens(text_col) if words_only else T.text_tokens(text_col)
    return df.select(F.col(id_col).alias("id"), F.posexplode(arr).alias("pos", "token"))


def vowel_share(text) -> "F.Column":
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    n = F.length(t)
    v = n - F.length(F.regexp_replace(t, "[aeiou]", ""))
    return F.when(n > 0, F.round(v / n, 4)).otherwise(F.lit(0.0))


def space_share(text) -> "F.Column":
    t = F.col(text) if isinstance(text, str) else text
    n = F.length(t)
    v = n - F.length(F.regexp_replace(t, " ", ""))
    return F.when(n > 0, F.round(v / n, 4)).otherwise(F.lit(0.0))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predictions(id, y, l0, l1, p, p2, source, lang, quality).

    y = toxic label; p = vowel share of the lower-cased text (rounded to 4
    places); two logits l0 = 0, l1 = 40 (p - 0.35); p2 = space share.
    """
    lab = labelled(spark, sf_dir)
    p = vowel_share("text")
    return lab.select(
        "id",
        F.col("toxic").alias("y"),
        F.lit(0.0).alias("l0"),
        (F.lit(40.0) * (p - F.lit(0.35))).alias("l1"),
        p.alias("p"),
        space_share("text").alias("p2"),
        "source",
        "lang",
        "quality",
    )


def task_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_labels(id, text, labels array<double>) with tasks (quality, toxic)."""
    lab = labelled(spark, sf_dir)
    return lab.select("id", "text", F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("labels"))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs(conv_id, turn, a, b): a turn and the next turn of the same conversation."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return (
        conv.withColumn("b", F.lead("text").over(w))
        .where(F.col("b").isNotNull())
        .select("conv_id", "turn", F.col("text").alias("a"), "b")
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """experiments(task, tokenizer_type, mol_rep, vocab_size, n, score, score_lb, score_ub, perplexity).

    One row per (lang, source, quality) group of the predictions: lang stands
    for the tokenizer type, the source number for the vocabulary size, the
    quality label for the representation.  score = accuracy of the hard
    prediction with a Wald interval; perplexity = exp(mean −ln p(true)).
    """
    p = predictions(spark, sf_dir)
    correct = F.when((F.col("l1") > F.col("l0")) == (F.col("y") == 1), 1.0).otherwise(0.0)
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("l0") - F.col("l1")))
    nll = -F.log(F.greatest(F.when(F.col("y") == 1, p1).otherwise(F.lit(1.0) - p1), F.lit(1e-15)))
    g = p.groupBy(
        F.col("lang").alias("tokenizer_type"),
        ((F.regexp_extract("source", r"([0-9]+)", 1).try_cast("int") + 1) * 100).alias("vocab_size"),
        F.when(F.col("quality") == 1, "smiles").otherwise("selfies").alias("mol_rep"),
    ).agg(F.count(F.lit(1)).alias("n"), F.avg(correct).alias("score"), F.exp(F.avg(nll)).alias("perplexity"))
    half = F.lit(1.96) * F.sqrt(F.col("score") * (F.lit(1.0) - F.col("score")) / F.col("n"))
    return g.select(
        F.lit("toxic").alias("task"),
        "tokenizer_type",
        "mol_rep",
        "vocab_size",
        "n",
        "score",
        (F.col("score") - half).alias("score_lb"),
        (F.col("score") + half).alias("score_ub"),
        "perplexity",
    )
