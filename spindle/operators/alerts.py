"""Structural-alert mining.

An *alert* is a token over-represented in positive rows:
  TP  = occurrences of the token in positive rows,
  FP  = number of negative rows whose text contains the token as a substring,
  PPV = TP / (TP + FP); alerts are candidates with PPV > threshold.
Every step is grouped by an optional ``task`` column, so all tasks of an
unpivoted label table are mined in one job instead of a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .joins import contained_tokens
from .util import written


def alert_candidates(pos_tokens: DataFrame, min_count: int = 3, min_len: int = 2, max_len: int = 40, group: tuple = ()) -> DataFrame:
    """#125: tokens of positive rows with ≥ min_count occurrences and length in [min_len, max_len]."""
    g = [*group, "token"]
    return (
        pos_tokens.where(F.length("token").between(min_len, max_len))
        .groupBy(*g)
        .agg(F.count(F.lit(1)).alias("tp"))
        .where(F.col("tp") >= min_count)
    )


def _labelled_words(rows: DataFrame, group: tuple) -> DataFrame:
    return rows.select(*group, "id", "label", F.explode(T.word_tokens("text")).alias("token"))


def alert_ppv(
    rows: DataFrame, min_count: int = 3, min_len: int = 2, max_len: int = 40, group: tuple = (), docs: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """#126: candidates with (tp, fp, ppv), plus the (token, id) containment relation.

    ``rows(group..., id, text, label)`` with label 0/1, an id once per group.  ``docs(id, text)`` are the texts that
    ``rows`` repeat for each group, where the caller has them; otherwise the rows are reduced to one for each id.
    The tokens of a text stay in one array and are only counted, so no (token, id) pair is shuffled.
    """
    g = list(group)
    pos_tok = _labelled_words(rows.where("label = 1"), group)
    cands = written(alert_candidates(pos_tok, min_count, min_len, max_len, group), "candidates")
    if g:
        docs = rows.select("id", "text").dropDuplicates(["id"]) if docs is None else docs
        # A row carries the groups in which it is negative, so what is found in it needs no join.
        neg = rows.groupBy("id").agg(F.collect_list(F.when(F.col("label") == 0, F.struct(*g))).alias("_g"))
        found = contained_tokens(cands.select("token"), docs.select("id", "text").join(neg, "id"), letters_only=True)
        hits = found.select("_g", F.explode("tokens").alias("token")).select(F.explode("_g").alias("_g"), "token").select("_g.*", "token")
    else:
        found = contained_tokens(cands.select("token"), rows.select("id", "label", "text"), letters_only=True)  # word-regex tokens
        hits = found.where("label = 0").select(F.explode("tokens").alias("token"))
    contains = found.select(F.explode("tokens").alias("token"), "id")
    fp = hits.groupBy(*g, "token").agg(F.count(F.lit(1)).alias("fp"))
    scored = (
        cands.join(fp, [*g, "token"], "left")
        .withColumn("fp", F.coalesce(F.col("fp"), F.lit(0)).cast("bigint"))
        .withColumn("tp", F.col("tp").cast("bigint"))
        .withColumn("ppv", F.col("tp") / (F.col("tp") + F.col("fp")))
    )
    return scored, contains


def structural_alerts(rows: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """#127: candidates with PPV > threshold → (group..., token, tp, fp, ppv)."""
    scored, _ = alert_ppv(rows, **kw)
    return scored.where(F.col("ppv") > threshold)


def coverage(alerts: DataFrame, docs: DataFrame, rows: DataFrame, group: tuple = ()) -> DataFrame:
    """#49: share of positive rows whose text, of ``docs(id, text)``, contains at least one alert, per group.

    The texts are searched for the groups of the alerts they hold: a row gives a group once, not its tokens.
    """
    g = list(group)
    name = F.to_json(F.struct(*g)) if g else F.lit("")
    known = alerts.dropna(subset=g) if g else alerts
    pos = rows.where("label = 1").select(*g, "id").distinct().withColumn("_g", name)
    found = contained_tokens(known.select("token", name.alias("_g")), docs.select("id", "text"), letters_only=True, value="_g")
    covered = found.select("id", F.explode("tokens").alias("_g")).distinct().withColumn("hit", F.lit(1))
    return (
        pos.join(covered, ["_g", "id"], "left")
        .groupBy(*g)
        .agg(F.count(F.lit(1)).alias("n_pos"), F.count("hit").alias("n_covered"))
        .withColumn("coverage", F.col("n_covered") / F.col("n_pos"))
    )


def alerts_per_task(rows_by_task: DataFrame, threshold: float = 0.5, docs: DataFrame | None = None, **kw) -> DataFrame:
    """#128: per task → n_neg, n_pos, n_alerts, coverage, mean_ppv (#129), in one grouped job."""
    group = ("task",)
    docs = rows_by_task.select("id", "text").dropDuplicates(["id"]) if docs is None else docs
    scored = written(alert_ppv(rows_by_task, group=group, docs=docs, **kw)[0], "scored")
    alerts = scored.where(F.col("ppv") > threshold)
    counts = rows_by_task.groupBy("task").agg(
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("bigint").alias("n_neg"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("bigint").alias("n_pos"),
    )
    per = scored.groupBy("task").agg(
        F.sum(F.when(F.col("ppv") > threshold, 1).otherwise(0)).cast("bigint").alias("n_alerts"),
        F.avg("ppv").alias("mean_ppv"),
    )
    cov = coverage(alerts, docs, rows_by_task, group).select("task", "coverage")
    return (
        counts.join(per, "task", "left")
        .join(cov, "task", "left")
        .select(
            "task",
            "n_neg",
            "n_pos",
            F.coalesce("n_alerts", F.lit(0)).cast("bigint").alias("n_alerts"),
            "coverage",
            "mean_ppv",
        )
    )
