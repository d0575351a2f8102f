"""Registered queries: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import aggregates as AG
from ..operators import vocab as V
from ..operators.joins import group_argmax
from ..sources import fixtures as X
from . import sql as S
from .registry import query

_P = S.with_(S.LABELLED, S.PREDICTIONS)
_E = S.with_(S.LABELLED, S.PREDICTIONS, S.EXPERIMENTS)


@query("count_tokens", S.with_(S.TOKENS) + "SELECT count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM tokens")
def q_count_tokens(spark, sf):
    return AG.count_tokens(X.tokens(X.corpus(spark, sf)))


@query("token_frequencies", S.with_(S.TOKENS) + "SELECT token, count(*) AS n FROM tokens GROUP BY token")
def q_token_frequencies(spark, sf):
    return V.token_counts(X.tokens(X.corpus(spark, sf)))


@query(
    "label_counts",
    "SELECT task, label, count(*) AS n FROM (SELECT 'quality' AS task, quality AS label FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY task, label",
)
def q_label_counts(spark, sf):
    lab = X.table(spark, sf, "labels").unpivot(["doc_id"], ["quality", "toxic"], "task", "label")
    return lab.groupBy("task", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "group_max",
    _E + "SELECT tokenizer_type, mol_rep, round(max(score), 6) AS max_score FROM experiments GROUP BY tokenizer_type, mol_rep",
)
def q_group_max(spark, sf):
    e = X.experiments(spark, sf)
    return e.groupBy("tokenizer_type", "mol_rep").agg(F.round(F.max("score"), 6).alias("max_score"))


@query(
    "group_argmax",
    _E + """SELECT tokenizer_type, mol_rep, vocab_size, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY tokenizer_type, mol_rep ORDER BY score DESC, vocab_size) AS rn FROM experiments) WHERE rn = 1""",
)
def q_group_argmax(spark, sf):
    best = group_argmax(X.experiments(spark, sf), ["tokenizer_type", "mol_rep"], "score", "vocab_size")
    return best.select("tokenizer_type", "mol_rep", "vocab_size", F.round("score", 6).alias("score"))


@query(
    "best_group_overall",
    _E + """SELECT tokenizer_type, mol_rep, vocab_size, round(score, 6) AS score FROM experiments WHERE tokenizer_type <> 'en'
ORDER BY score DESC, vocab_size, tokenizer_type, mol_rep LIMIT 1""",
)
def q_best_group_overall(spark, sf):
    e = X.experiments(spark, sf).where(F.col("tokenizer_type") != "en")
    top = e.orderBy(F.col("score").desc(), "vocab_size", "tokenizer_type", "mol_rep").limit(1)
    return top.select("tokenizer_type", "mol_rep", "vocab_size", F.round("score", 6).alias("score"))


@query(
    "mean_median_std",
    _P + "SELECT lang, round(avg(p), 6) AS mean, round(quantile_cont(p, 0.5), 6) AS median, round(stddev_pop(p), 6) AS std FROM predictions GROUP BY lang",
)
def q_mean_median_std(spark, sf):
    r = AG.mean_median_std(X.predictions(spark, sf), "p", ("lang",))
    return r.select("lang", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


@query(
    "marginal_error",
    _P + "SELECT lang, count(*) AS n, round(1.96e0 * stddev_pop(p) / sqrt(count(*)), 6) AS margin FROM predictions GROUP BY lang",
)
def q_marginal_error(spark, sf):
    r = AG.marginal_error(X.predictions(spark, sf), "p", ("lang",))
    return r.select("lang", "n", F.round("margin", 6).alias("margin"))


@query(
    "minmax_normalise",
    _P + """SELECT p.id, p.lang, round(CASE WHEN m.hi > m.lo THEN (p.p - m.lo) / (m.hi - m.lo) ELSE 0.0 END, 6) AS p_norm
FROM predictions p JOIN (SELECT lang, min(p) AS lo, max(p) AS hi FROM predictions GROUP BY lang) m ON p.lang = m.lang""",
)
def q_minmax_normalise(spark, sf):
    r = AG.minmax_normalise(X.predictions(spark, sf).select("id", "lang", "p"), "p", ("lang",))
    return r.select("id", "lang", F.round("p_norm", 6).alias("p_norm"))


@query(
    "signed_intensity",
    _P + """SELECT p.id, p.lang, sign(p.l1) AS sign, round(CASE WHEN m.mx > 0 THEN 0.5 + 0.5 * abs(p.l1) / m.mx ELSE 0.5 END, 6) AS intensity
FROM predictions p JOIN (SELECT lang, max(abs(l1)) AS mx FROM predictions GROUP BY lang) m ON p.lang = m.lang""",
)
def q_signed_intensity(spark, sf):
    r = AG.signed_intensity(X.predictions(spark, sf).select("id", "lang", "l1"), "l1", ("lang",))
    return r.select("id", "lang", F.col("sign").cast("int").alias("sign"), F.round("intensity", 6).alias("intensity"))


@query(
    "pearson_corr",
    _P + "SELECT lang, count(*) AS n, round(corr(p, p2), 6) AS r FROM predictions GROUP BY lang HAVING count(*) >= 2",
)
def q_pearson_corr(spark, sf):
    r = AG.pearson(X.predictions(spark, sf), "p", "p2", ("lang",))
    return r.select("lang", "n", F.round("r", 6).alias("r"))


@query(
    "vocab_duration_stats",
    "SELECT event_type AS tokenizer, user_id AS vocab, count(*) AS n, round(avg(value), 6) AS mean_seconds FROM events GROUP BY event_type, user_id",
)
def q_vocab_duration_stats(spark, sf):
    e = X.table(spark, sf, "events").select(F.col("event_type").alias("tokenizer"), F.col("user_id").alias("vocab"), F.col("value").alias("seconds"))
    r = e.groupBy("tokenizer", "vocab").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("seconds"), 6).alias("mean_seconds"))
    return r.orderBy("tokenizer", "vocab")


@query(
    "bucket_counts",
    _P + """SELECT y AS actual, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM predictions
GROUP BY GROUPING SETS ((y, CASE WHEN l1 > l0 THEN 1 ELSE 0 END), (CASE WHEN l1 > l0 THEN 1 ELSE 0 END))""",
)
def q_bucket_counts(spark, sf):
    return AG.bucket_counts(X.predictions(spark, sf))


@query(
    "weighted_model_score",
    _P + """, s AS (SELECT lang, sum(CASE WHEN y = 1 AND l1 > l0 THEN 1 ELSE 0 END) AS tp, sum(y) AS pos,
  sum(CASE WHEN y = 0 AND NOT (l1 > l0) THEN 1 ELSE 0 END) AS tn, sum(1 - y) AS neg FROM predictions GROUP BY lang),
w AS (SELECT lang, 6e-1 * (CASE WHEN pos > 0 THEN tp / pos ELSE 0.0 END) + 4e-1 * (CASE WHEN neg > 0 THEN tn / neg ELSE 0.0 END) AS ws FROM s)
SELECT lang, round(ws, 6) AS weighted_score, row_number() OVER (ORDER BY ws DESC, lang) = 1 AS best FROM w""",
)
def q_weighted_model_score(spark, sf):
    r = AG.weighted_model_score(X.predictions(spark, sf), ("lang",))
    return r.select("lang", F.round("weighted_score", 6).alias("weighted_score"), "best")


_TOK500 = (
    "tvocab AS (SELECT token FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rn FROM "
    "(SELECT token, count(*) AS n FROM tokens GROUP BY token)) WHERE rn <= 500)"
)


@query(
    "pct_convertible",
    S.with_(S.TOKENS, _TOK500)
    + """SELECT t.id, count(*) AS n_known, round(100.0 * avg(CASE WHEN regexp_full_match(t.token, '\\p{L}+') THEN 1.0 ELSE 0.0 END), 6) AS pct
FROM tokens t JOIN tvocab v ON v.token = t.token GROUP BY t.id""",
)
def q_pct_convertible(spark, sf):
    tok = X.tokens(X.corpus(spark, sf))
    vocab = V.top_k_vocab(tok, 500)
    r = AG.pct_convertible(tok, vocab, F.col("token").rlike(r"^\p{L}+$"))
    return r.select("id", "n_known", F.round("pct", 6).alias("pct")).orderBy(F.col("pct").desc(), "id")



