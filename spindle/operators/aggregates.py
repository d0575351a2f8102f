"""Grouped aggregates.

Per-group statistics that the reference computes with a window over a group
(normalising, intensities) are an aggregate joined back to the rows: the
aggregate is combined map-side, so a group holding a third of the rows
costs no more than any other group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metrics import hard_pred
from .util import with_group_stats
from .vocab import UNK_ID, lookup_ids
from .windows import quantiles, with_quantiles

Z_95 = 1.96  # fixed value: normal quantile used for marginal errors


def count_tokens(tok: DataFrame, approx: bool = False) -> DataFrame:
    """#36: (total tokens, distinct tokens); ``approx`` uses HyperLogLog++."""
    d = F.approx_count_distinct("token") if approx else F.countDistinct("token")
    return tok.agg(F.count(F.lit(1)).alias("n_tokens"), d.alias("n_distinct"))


def mean_median_std(df: DataFrame, value: str, group: tuple = ()) -> DataFrame:
    """#43: mean, exact median (linear interpolation, see ``quantiles``) and population std."""
    stats = df.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return with_quantiles(stats, quantiles(df, value, {"median": 0.5}, group), group).select(*group, "mean", "median", "std")


def marginal_error(df: DataFrame, value: str, group: tuple = (), z: float = Z_95) -> DataFrame:
    """#44: z · stddev_pop / √n."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), (F.lit(z) * F.stddev_pop(value) / F.sqrt(F.count(F.lit(1)))).alias("margin")
    )


def minmax_normalise(df: DataFrame, value: str, group: tuple = (), out: str | None = None) -> DataFrame:
    """#45: (x − min) / (max − min) within each group (0 when max = min)."""
    out = out or f"{value}_norm"
    g = list(group)
    m = df.groupBy(*g).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    j = with_group_stats(df, m, g)
    rng = F.col("_hi") - F.col("_lo")
    return j.withColumn(out, F.when(rng > 0, (F.col(value) - F.col("_lo")) / rng).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def signed_intensity(df: DataFrame, value: str, group: tuple = ()) -> DataFrame:
    """#46: sign(x) and 0.5 + 0.5·|x| / max|x| within the group."""
    g = list(group)
    m = df.groupBy(*g).agg(F.max(F.abs(value)).alias("_mx"))
    j = with_group_stats(df, m, g)
    inten = F.when(F.col("_mx") > 0, F.lit(0.5) + F.lit(0.5) * F.abs(value) / F.col("_mx")).otherwise(F.lit(0.5))
    return j.withColumn("sign", F.signum(value)).withColumn("intensity", inten).drop("_mx")


def pearson(df: DataFrame, a: str, b: str, group: tuple = ()) -> DataFrame:
    """#47: Pearson correlation per group, only groups with ≥ 2 rows."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r")).where(F.col("n") >= 2)


def bucket_counts(pred: DataFrame) -> DataFrame:
    """#50: (actual × predicted) counts plus predicted-only totals in one grouping-sets aggregate."""
    p = pred.select(F.col("y").alias("actual"), hard_pred().alias("predicted"))
    return p.groupingSets([["actual", "predicted"], ["predicted"]], "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def weighted_model_score(pred: DataFrame, group: tuple, w_pos: float = 0.6, w_neg: float = 0.4) -> DataFrame:
    """#51: w_pos·TP/pos + w_neg·TN/neg per model and a flag on the best one
    (ties to the smallest model key).  The ranking window runs over the
    aggregated table, one row per model."""
    yhat = hard_pred()
    s = pred.groupBy(*group).agg(
        F.sum(F.when((F.col("y") == 1) & (yhat == 1), 1).otherwise(0)).alias("tp"),
        F.sum("y").alias("pos"),
        F.sum(F.when((F.col("y") == 0) & (yhat == 0), 1).otherwise(0)).alias("tn"),
        F.sum(F.lit(1) - F.col("y")).alias("neg"),
    )
    ws = F.lit(w_pos) * F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0) + F.lit(w_neg) * F.when(
        F.col("neg") > 0, F.col("tn") / F.col("neg")
    ).otherwise(0.0)
    s = s.withColumn("weighted_score", ws)
    rank = F.row_number().over(Window.orderBy(F.col("weighted_score").desc(), *[F.col(c) for c in group]))
    return s.withColumn("best", rank == 1)


def pct_convertible(tok: DataFrame, vocab: DataFrame, valid: Column) -> DataFrame:
    """#52: per row, share (in %) of the known (non-[UNK]) tokens that satisfy ``valid``."""
    j = lookup_ids(tok, vocab).where(F.col("tid") != UNK_ID)
    return j.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_known"), (F.lit(100.0) * F.avg(F.when(valid, 1.0).otherwise(0.0))).alias("pct")
    )
