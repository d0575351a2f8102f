"""Token attributions for the linear log-odds scorer.

Every method produces the long table ``attributions(method, <key…>, rep,
pos, token, score)``; ``key`` may hold several columns (e.g. a perturbation
variant and the row id) so originals and perturbed copies are explained in
one job.  For a linear scorer the gradient methods have closed forms, so
they are joins and grouped sums, not per-row model calls.  Where all methods
are needed, whole rows are explained where they lie (``rowwise``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField
from pyspark.sql.window import Window

from .rowwise import DOUBLE, INT, STRING, measured

METHODS = ("ig", "shap", "occlusion", "sampled")


def _reps(df: DataFrame, reps: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def attr_ig_linear(tw: DataFrame, key: list[str], reps: int = 1) -> DataFrame:
    """#137: integrated gradients from a zero baseline = x·w per position, L2-normalised per row."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*key)))
    s = tw.withColumn("score", F.when(norm > 0, F.col("w") / norm).otherwise(F.lit(0.0)))
    return _reps(s.select(*key, "pos", "token", "score"), reps).withColumn("method", F.lit("ig"))


def duplicate_token_restore(tw: DataFrame, per_token: DataFrame, key: list[str]) -> DataFrame:
    """#60: give every position the score of its (distinct) token; tokens the
    explainer did not score get 0 (any multiplicity, not only pairs)."""
    return tw.select(*key, "pos", "token").join(per_token, [*key, "token"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def token_means(tw: DataFrame, key: list[str]) -> DataFrame:
    """E[x_t]: mean count of each token per row over the explained rows."""
    n_rows = tw.select(*key).distinct().agg(F.count(F.lit(1))).scalar()
    return tw.groupBy("token").agg((F.count(F.lit(1)) / n_rows).alias("mean_x"))


def attr_shap_linear(tw: DataFrame, key: list[str], means: DataFrame, reps: int = 1) -> DataFrame:
    """#138: Shapley values of a linear model with independent features: w·(x − E[x])."""
    per = tw.groupBy(*key, "token").agg(F.count(F.lit(1)).alias("x"), F.first("w").alias("w"))
    per = per.join(means, "token", "left").select(*key, "token", (F.col("w") * (F.col("x") - F.coalesce("mean_x", F.lit(0.0)))).alias("score"))
    return _reps(duplicate_token_restore(tw, per, key), reps).withColumn("method", F.lit("shap"))


def attr_occlusion(tw: DataFrame, key: list[str], reps: int = 1) -> DataFrame:
    """#139: score(row) − score(row without the token) = x·w for every occurrence."""
    per = tw.groupBy(*key, "token").agg((F.count(F.lit(1)) * F.first("w")).alias("score"))
    return _reps(duplicate_token_restore(tw, per, key), reps).withColumn("method", F.lit("occlusion"))


def attr_sampled(tw: DataFrame, key: list[str], prior: Column, samples: int = 16, reps: int = 1, seed: int = 42) -> DataFrame:
    """#140: LIME-style local effect.  Sample s of rep r keeps a position when
    bit s mod 32 of md5(seed:rep:key:s div 32:pos) is set; the effect of a position is mean score of
    the samples that keep it minus mean score of those that drop it (0 when
    one side is empty), mean-centred per (row, rep).

    ``tw``: rows of ``weighted_rows``; all samples of a row are drawn and scored where it lies."""
    return _long(tw, key, prior, ("sampled",), reps, samples, seed)


def explain_all_methods(tw: DataFrame, key: list[str], prior: Column, reps: int = 2, samples: int = 16, seed: int = 42) -> DataFrame:
    """#141: all methods × repetitions in one long table; tokens stripped
    of whitespace / continuation markers.

    ``tw``: rows of ``weighted_rows``.  Every score needs its own row only (norm, count of the token, samples), so
    nothing is shuffled here."""
    return _long(tw, key, prior, METHODS, reps, samples, seed)


def _long(tw: DataFrame, key: list[str], prior: Column, methods: tuple, reps: int, samples: int, seed) -> DataFrame:
    def scores(row, copies):
        for m in methods:
            for rep in range(reps):
                yield m, rep, row.pos, row.labels, row.score(m, rep)

    fields = [StructField("method", STRING), StructField("rep", INT), StructField("pos", ArrayType(INT)), StructField("token", ArrayType(STRING)), StructField("score", ArrayType(DOUBLE))]
    each = measured(tw, key, prior, scores, fields, samples, seed)
    each = each.select("method", *key, "rep", F.explode(F.arrays_zip("pos", "token", "score")).alias("_z"))
    return each.select("method", *key, "rep", "_z.pos", "_z.token", "_z.score")


def rank_explanations(attr: DataFrame, key: list[str]) -> DataFrame:
    """#55: rank of each position inside (method, row, rep) by score desc, then position."""
    w = Window.partitionBy("method", *key, "rep").orderBy(F.col("score").desc(), F.col("pos"))
    return attr.withColumn("rank", F.row_number().over(w))


def top_fraction(attr: DataFrame, key: list[str], frac: float = 0.4) -> DataFrame:
    """#56: the top max(1, int(n·frac)) ranked positions of each (method, row, rep)."""
    r = rank_explanations(attr, key).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("method", *key, "rep")))
    return r.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(frac)))).drop("_n")


def attr_matrix(tw: DataFrame, key: list[str], prior: Column, methods=METHODS, samples: int = 16, seed: int = 42) -> DataFrame:
    """#142: per (row, token) one column per method (sum over positions, rep 0); ``tw``: rows of ``weighted_rows``."""

    def sums(row, copies):
        labels, at = np.unique(row.labels, return_inverse=True)
        yield labels, *[np.bincount(at, row.score(m), len(labels)) for m in methods]

    fields = [StructField("token", ArrayType(STRING)), *[StructField(m, ArrayType(DOUBLE)) for m in methods]]
    each = measured(tw, key, prior, sums, fields, samples, seed)
    each = each.select(*key, F.explode(F.arrays_zip("token", *methods)).alias("_z"))
    return each.select(*key, "_z.token", *[f"_z.{m}" for m in methods])
