"""Experiment-analysis reports.

Reports run over result tables that hold one row per configuration, so
windows here partition by tokenizer / representation over a few rows each.
Numbers are compared as numbers, never as formatted strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import group_argmax
from .windows import quantiles, with_quantiles


def best_vocab(res: DataFrame, group=("tokenizer_type", "mol_rep"), score: str = "score") -> DataFrame:
    """#156: best vocabulary size per group with error bars (score − lb, ub − score)."""
    b = group_argmax(res, list(group), score, "vocab_size")
    return b.select(*group, "vocab_size", score, (F.col(score) - F.col(f"{score}_lb")).alias("err_lo"), (F.col(f"{score}_ub") - F.col(score)).alias("err_hi"))


def vocab_series(res: DataFrame, baseline: str, score: str = "score") -> DataFrame:
    """#157: score by vocabulary size for every non-baseline tokenizer, with the
    baseline tokenizer's best score of the same representation as a reference line."""
    base = res.where(F.col("tokenizer_type") == baseline).groupBy("mol_rep").agg(F.max(score).alias("baseline"))
    return res.where(F.col("tokenizer_type") != baseline).join(base, "mol_rep", "left").select(
        "tokenizer_type", "mol_rep", "vocab_size", score, "baseline"
    )


def vocab_rank_series(res: DataFrame, group=("tokenizer_type", "mol_rep"), score: str = "score") -> DataFrame:
    """#59: series ordered by vocabulary size inside each group, with the change to the previous size."""
    w = Window.partitionBy(*group).orderBy("vocab_size")
    return res.select(*group, "vocab_size", score, (F.col(score) - F.lag(score).over(w)).alias("delta"), F.row_number().over(w).alias("step"))


def optimal_by_task(res: DataFrame, group=("task", "tokenizer_type")) -> DataFrame:
    """#158: per group the max score with its vocab and variability (score − lb),
    and the min perplexity with its vocab; the two argmaxes joined."""
    g = list(group)
    a = group_argmax(res, g, "score", "vocab_size").select(
        *g, F.col("score").alias("best_score"), F.col("vocab_size").alias("best_score_vocab"), (F.col("score") - F.col("score_lb")).alias("variability")
    )
    b = group_argmax(res, g, "perplexity", "vocab_size", desc=False).select(
        *g, F.col("perplexity").alias("min_ppl"), F.col("vocab_size").alias("min_ppl_vocab")
    )
    return a.join(b, g, "left")


def rep_compare(res: DataFrame, keys=("task", "tokenizer_type", "vocab_size"), reps=("smiles", "selfies")) -> DataFrame:
    """#159: the two representations side by side (score and interval half-widths)."""
    k = list(keys)
    sides = []
    for r in reps:
        sides.append(
            res.where(F.col("mol_rep") == r).select(
                *k, F.col("score").alias(f"score_{r}"), (F.col("score_ub") - F.col("score")).alias(f"err_{r}")
            )
        )
    return sides[0].join(sides[1], k, "full_outer")


def best_tokenizers(res: DataFrame, score: str = "score") -> DataFrame:
    """#160: max score per tokenizer, best first."""
    return res.groupBy("tokenizer_type").agg(F.max(score).alias("max_score")).orderBy(F.col("max_score").desc(), "tokenizer_type")


def perplexity_by_size(res: DataFrame) -> DataFrame:
    """#161: mean perplexity by size inside each tokenizer with the change to the previous size."""
    m = res.groupBy("tokenizer_type", "vocab_size").agg(F.avg("perplexity").alias("perplexity"))
    w = Window.partitionBy("tokenizer_type").orderBy("vocab_size")
    return m.withColumn("delta", F.col("perplexity") - F.lag("perplexity").over(w))


def baseline_report(res: DataFrame, baseline: str, score: str = "score") -> DataFrame:
    """#162: the baseline tokenizer's best score per representation with error bars."""
    b = res.where(F.col("tokenizer_type") == baseline)
    return best_vocab(b, ("mol_rep",), score)


def training_log(lines: DataFrame, text: str = "line") -> DataFrame:
    """#163: split JSON trainer-log lines into train rows (have ``loss``) and eval
    rows (have ``eval_loss``), long form (kind, epoch, metric, value)."""
    j = F.col(text)
    has_loss = F.get_json_object(j, "$.loss").isNotNull()
    has_eval = F.get_json_object(j, "$.eval_loss").isNotNull()
    base = lines.select(
        F.when(has_eval, "eval").when(has_loss, "train").alias("kind"),
        F.get_json_object(j, "$.epoch").try_cast("double").alias("epoch"),
        F.get_json_object(j, "$.loss").try_cast("double").alias("loss"),
        F.get_json_object(j, "$.eval_loss").try_cast("double").alias("eval_loss"),
        F.get_json_object(j, "$.eval_auc").try_cast("double").alias("eval_auc"),
    ).where(F.col("kind").isNotNull())
    long = base.unpivot(["kind", "epoch"], ["loss", "eval_loss", "eval_auc"], "metric", "value").where(F.col("value").isNotNull())
    return long


def distribution(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """#164: box / violin inputs: min, q1, median, q3, max, mean (exact, see ``quantiles``)."""
    stats = df.groupBy(*group).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    quarts = quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, tuple(group))
    return with_quantiles(stats, quarts, tuple(group)).select(*group, "min", "q1", "median", "q3", "max", "mean", "n")
