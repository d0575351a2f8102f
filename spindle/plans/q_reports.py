"""Registered queries: experiment-analysis reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from ..sources import fixtures as X
from . import sql as S
from .registry import query

_E = S.with_(S.LABELLED, S.PREDICTIONS, S.EXPERIMENTS)
BASELINE = "en"


def _r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query(
    "r_best_vocab",
    _E + """SELECT tokenizer_type, mol_rep, vocab_size, round(score, 6) AS score, round(score - score_lb, 6) AS err_lo, round(score_ub - score, 6) AS err_hi
FROM (SELECT *, row_number() OVER (PARTITION BY tokenizer_type, mol_rep ORDER BY score DESC, vocab_size) AS rn FROM experiments) WHERE rn = 1""",
)
def q_best_vocab(spark, sf):
    r = R.best_vocab(X.experiments(spark, sf))
    return r.select("tokenizer_type", "mol_rep", "vocab_size", *_r6("score", "err_lo", "err_hi"))


@query(
    "r_vocab_series",
    _E + f"""SELECT e.tokenizer_type, e.mol_rep, e.vocab_size, round(e.score, 6) AS score, round(b.baseline, 6) AS baseline FROM experiments e
LEFT JOIN (SELECT mol_rep, max(score) AS baseline FROM experiments WHERE tokenizer_type = '{BASELINE}' GROUP BY mol_rep) b ON b.mol_rep = e.mol_rep
WHERE e.tokenizer_type <> '{BASELINE}'""",
)
def q_vocab_series(spark, sf):
    r = R.vocab_series(X.experiments(spark, sf), BASELINE)
    return r.select("tokenizer_type", "mol_rep", "vocab_size", *_r6("score", "baseline"))


@query(
    "vocab_rank_series",
    _E + """SELECT tokenizer_type, mol_rep, vocab_size, round(score, 6) AS score,
  round(score - lag(score) OVER (PARTITION BY tokenizer_type, mol_rep ORDER BY vocab_size), 6) AS delta,
  CAST(row_number() OVER (PARTITION BY tokenizer_type, mol_rep ORDER BY vocab_size) AS INTEGER) AS step FROM experiments""",
)
def q_vocab_rank_series(spark, sf):
    r = R.vocab_rank_series(X.experiments(spark, sf))
    return r.select("tokenizer_type", "mol_rep", "vocab_size", *_r6("score", "delta"), "step")


@query(
    "r_optimal_by_task",
    _E + """, a AS (SELECT task, tokenizer_type, score AS best_score, vocab_size AS best_score_vocab, score - score_lb AS variability FROM
  (SELECT *, row_number() OVER (PARTITION BY task, tokenizer_type ORDER BY score DESC, vocab_size) AS rn FROM experiments) WHERE rn = 1),
b AS (SELECT task, tokenizer_type, perplexity AS min_ppl, vocab_size AS min_ppl_vocab FROM
  (SELECT *, row_number() OVER (PARTITION BY task, tokenizer_type ORDER BY perplexity, vocab_size) AS rn FROM experiments) WHERE rn = 1)
SELECT a.task, a.tokenizer_type, round(best_score, 6) AS best_score, best_score_vocab, round(variability, 6) AS variability,
  round(min_ppl, 6) AS min_ppl, min_ppl_vocab FROM a LEFT JOIN b ON a.task = b.task AND a.tokenizer_type = b.tokenizer_type""",
)
def q_optimal_by_task(spark, sf):
    r = R.optimal_by_task(X.experiments(spark, sf))
    return r.select("task", "tokenizer_type", F.round("best_score", 6).alias("best_score"), "best_score_vocab",
                    F.round("variability", 6).alias("variability"), F.round("min_ppl", 6).alias("min_ppl"), "min_ppl_vocab")


@query(
    "r_rep_compare",
    _E + """, sm AS (SELECT task, tokenizer_type, vocab_size, score AS score_smiles, score_ub - score AS err_smiles FROM experiments WHERE mol_rep = 'smiles'),
se AS (SELECT task, tokenizer_type, vocab_size, score AS score_selfies, score_ub - score AS err_selfies FROM experiments WHERE mol_rep = 'selfies')
SELECT coalesce(sm.task, se.task) AS task, coalesce(sm.tokenizer_type, se.tokenizer_type) AS tokenizer_type, coalesce(sm.vocab_size, se.vocab_size) AS vocab_size,
  round(score_smiles, 6) AS score_smiles, round(err_smiles, 6) AS err_smiles, round(score_selfies, 6) AS score_selfies, round(err_selfies, 6) AS err_selfies
FROM sm FULL OUTER JOIN se ON sm.task = se.task AND sm.tokenizer_type = se.tokenizer_type AND sm.vocab_size = se.vocab_size""",
)
def q_rep_compare(spark, sf):
    r = R.rep_compare(X.experiments(spark, sf))
    return r.select("task", "tokenizer_type", "vocab_size", *_r6("score_smiles", "err_smiles", "score_selfies", "err_selfies"))


@query(
    "r_best_tokenizers",
    _E + "SELECT tokenizer_type, round(max(score), 6) AS max_score FROM experiments GROUP BY tokenizer_type ORDER BY max_score DESC, tokenizer_type",
)
def q_best_tokenizers(spark, sf):
    r = R.best_tokenizers(X.experiments(spark, sf))
    return r.select("tokenizer_type", F.round("max_score", 6).alias("max_score"))


@query(
    "r_perplexity_by_size",
    _E + """SELECT tokenizer_type, vocab_size, round(perplexity, 6) AS perplexity,
  round(perplexity - lag(perplexity) OVER (PARTITION BY tokenizer_type ORDER BY vocab_size), 6) AS delta
FROM (SELECT tokenizer_type, vocab_size, avg(perplexity) AS perplexity FROM experiments GROUP BY tokenizer_type, vocab_size)""",
)
def q_perplexity_by_size(spark, sf):
    r = R.perplexity_by_size(X.experiments(spark, sf))
    return r.select("tokenizer_type", "vocab_size", *_r6("perplexity", "delta"))


@query(
    "r_atomwise",
    _E + f"""SELECT mol_rep, vocab_size, round(score, 6) AS score, round(score - score_lb, 6) AS err_lo, round(score_ub - score, 6) AS err_hi
FROM (SELECT *, row_number() OVER (PARTITION BY mol_rep ORDER BY score DESC, vocab_size) AS rn FROM experiments WHERE tokenizer_type = '{BASELINE}') WHERE rn = 1""",
)
def q_atomwise(spark, sf):
    r = R.baseline_report(X.experiments(spark, sf), BASELINE)
    return r.select("mol_rep", "vocab_size", *_r6("score", "err_lo", "err_hi"))


@query(
    "r_training_log",
    """SELECT kind, epoch, metric, count(*) AS n, round(avg(value), 6) AS mean_value FROM (
  SELECT 'train' AS kind, CAST(hour(ts) AS DOUBLE) AS epoch, 'loss' AS metric, value FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'eval', CAST(hour(ts) AS DOUBLE), 'eval_loss', value FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'eval', CAST(hour(ts) AS DOUBLE), 'eval_auc', value / 100.0 FROM events WHERE event_type = 'click') GROUP BY kind, epoch, metric""",
)
def q_training_log(spark, sf):
    e = X.table(spark, sf, "events")
    epoch = F.hour("ts")
    line = (
        F.when(F.col("event_type") == "view", F.to_json(F.struct(epoch.alias("epoch"), F.col("value").alias("loss"))))
        .when(
            F.col("event_type") == "click",
            F.to_json(F.struct(epoch.alias("epoch"), F.col("value").alias("eval_loss"), (F.col("value") / 100.0).alias("eval_auc"))),
        )
        .otherwise(F.to_json(F.struct(epoch.alias("epoch"), F.col("event_type").alias("note"))))
    )
    long = R.training_log(e.select(line.alias("line")))
    return long.groupBy("kind", "epoch", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(
    "r_distribution",
    S.with_(S.LABELLED, S.PREDICTIONS)
    + """SELECT lang, quality, round(min(p), 6) AS min, round(quantile_cont(p, 0.25), 6) AS q1, round(quantile_cont(p, 0.5), 6) AS median,
  round(quantile_cont(p, 0.75), 6) AS q3, round(max(p), 6) AS max, round(avg(p), 6) AS mean, count(*) AS n FROM predictions GROUP BY lang, quality""",
)
def q_distribution(spark, sf):
    r = R.distribution(X.predictions(spark, sf), "p", ["lang", "quality"])
    return r.select("lang", "quality", *_r6("min", "q1", "median", "q3", "max", "mean"), "n")
