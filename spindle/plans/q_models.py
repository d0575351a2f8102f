"""Registered queries: language model, scorer, classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model as MD
from ..operators import sample as SM
from ..operators.util import written
from ..sources import fixtures as X
from . import sql as S
from .q_sample import _RANDOM
from .registry import query


def _lm_train(spark, sf):
    docs = X.corpus(spark, sf)
    split = SM.random_split(docs.select("id"), seed=42)
    return docs.join(split.where("split = 'train'"), "id", "left_semi")


def _heldout(spark, sf):
    return X.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")


def _bigram_sql(src: str) -> str:
    return f"""SELECT id, generate_subscripts(t, 1) - 1 AS pos, unnest(p) AS prev, unnest(t) AS token FROM (
    SELECT id, ['<s>'] || w AS p, w || ['</s>'] AS t FROM (SELECT id, regexp_extract_all(lower(text), '{S.WORD_RE}', 1) AS w FROM {src}))"""


_LM = S.with_(
    _RANDOM,
    "train AS (SELECT d.doc_id AS id, d.text FROM documents d JOIN rs ON rs.id = d.doc_id WHERE rs.split = 'train')",
    f"tb AS ({_bigram_sql('train')})",
    "cnt AS (SELECT prev, token, count(*) AS n FROM tb GROUP BY prev, token)",
    "pt AS (SELECT prev, sum(n) AS n_prev FROM cnt GROUP BY prev)",
    "vv AS (SELECT count(DISTINCT token) + 1 AS V FROM tb)",
    "voc AS (SELECT DISTINCT token FROM tb)",
    "held AS (SELECT item_id AS id, text FROM benchmark)",
    f"hb AS ({_bigram_sql('held')})",
    """hm AS (SELECT id, pos, CASE WHEN prev = '<s>' OR prev IN (SELECT token FROM voc) THEN prev ELSE '<unk>' END AS prev,
     CASE WHEN token IN (SELECT token FROM voc) THEN token ELSE '<unk>' END AS token FROM hb)""",
    """sc AS (SELECT hm.id, hm.pos, CASE WHEN pt.n_prev IS NULL THEN -ln((SELECT V FROM vv))
     ELSE ln((coalesce(c.n, 0) + 5e-1) / (pt.n_prev + 5e-1 * (SELECT V FROM vv))) END AS logp
     FROM hm LEFT JOIN cnt c ON c.prev = hm.prev AND c.token = hm.token LEFT JOIN pt ON pt.prev = hm.prev)""",
    "sen AS (SELECT id, count(*) AS n_tokens, sum(logp) AS sum_logp, exp(-sum(logp) / count(*)) AS ppl FROM sc GROUP BY id)",
    f"msk AS (SELECT sc.*, {S.md5_int(chr(39) + '42:' + chr(39) + ' || id || ' + chr(39) + ':' + chr(39) + ' || pos')} / 4294967296.0 < 1.5e-1 AS masked FROM sc)",
)


@query(
    "ngram_lm",
    _LM + "SELECT c.prev, c.token, c.n, round(ln((c.n + 5e-1) / (pt.n_prev + 5e-1 * (SELECT V FROM vv))), 6) AS logp FROM cnt c JOIN pt ON c.prev = pt.prev",
)
def q_ngram_lm(spark, sf):
    model, _, _ = MD.train_bigram_lm(_lm_train(spark, sf))
    return model.select("prev", "token", "n", F.round("logp", 6).alias("logp"))


def _scored(spark, sf):
    return MD.score_bigrams(_heldout(spark, sf), _lm_train(spark, sf), "id")


@query("sentence_loss", _LM + "SELECT id, n_tokens, round(sum_logp, 6) AS sum_logp, round(ppl, 6) AS ppl FROM sen")
def q_sentence_loss(spark, sf):
    s = MD.sentence_loss(_scored(spark, sf), "id")
    return s.select("id", "n_tokens", F.round("sum_logp", 6).alias("sum_logp"), F.round("ppl", 6).alias("ppl"))


@query(
    "loss_per_position",
    _LM + "SELECT id, count(*) AS n_masked, round(avg(-logp), 6) AS loss, round(exp(avg(-logp)), 6) AS ppl FROM msk WHERE masked GROUP BY id",
)
def q_loss_per_position(spark, sf):
    s = MD.loss_per_position(_scored(spark, sf), "id")
    return s.select("id", "n_masked", F.round("loss", 6).alias("loss"), F.round("ppl", 6).alias("ppl"))


@query(
    "corpus_perplexity",
    _LM
    + """SELECT round(exp(sum(-logp) / count(*)), 6) AS ppl_per_token,
  round(exp(sum(CASE WHEN masked THEN -logp END) / count(CASE WHEN masked THEN 1 END)), 6) AS ppl_masked,
  round(exp(-(SELECT sum(sum_logp) FROM sen) / (SELECT sum(n_tokens - 1) FROM sen)), 6) AS ppl_sen_minus,
  round(exp((SELECT sum(sum_logp) FROM sen) / (SELECT sum(n_tokens - 1) FROM sen)), 6) AS ppl_sen_plus,
  round((SELECT avg(ppl) FROM sen), 6) AS ppl_mean,
  round((SELECT sum(ppl) FROM sen) / count(*), 6) AS ppl_sum_per_token FROM msk""",
)
def q_corpus_perplexity(spark, sf):
    c = MD.corpus_perplexity(_scored(spark, sf), "id")
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


LOG_ODDS = S.with_(
    S.LABELLED,
    f"yt AS (SELECT id, toxic AS y, unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1)) AS token FROM labelled)",
    "cnt AS (SELECT token, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS fp FROM yt GROUP BY token)",
    "tot AS (SELECT sum(tp) AS P, sum(fp) AS N, count(*) AS V FROM cnt)",
    "w AS (SELECT token, ln((tp + 1) / (P + V)) - ln((fp + 1) / (N + V)) AS w FROM cnt, tot)",
    "prior AS (SELECT ln(sum(toxic) / sum(1 - toxic)) AS prior FROM labelled)",
    """sc AS (SELECT l.id, l.toxic AS y, (SELECT prior FROM prior) + coalesce(s.s, 0.0) AS logit FROM labelled l
     LEFT JOIN (SELECT yt.id, sum(w.w) AS s FROM yt JOIN w ON yt.token = w.token GROUP BY yt.id) s ON s.id = l.id)""",
)


def scorer(spark, sf):
    lab = X.labelled(spark, sf).withColumnRenamed("toxic", "y")
    w, prior = MD.train_log_odds(lab)
    return lab, written(w, "log-odds"), prior


@query("log_odds_scorer", LOG_ODDS + "SELECT id, y, round(logit, 6) AS logit FROM sc")
def q_log_odds_scorer(spark, sf):
    lab, w, prior = scorer(spark, sf)
    return MD.log_odds_scores(lab.select("id", "y", "text"), w, prior).select("id", "y", F.round("logit", 6).alias("logit"))


@query(
    "predict_label",
    LOG_ODDS
    + """SELECT id, round(1.0 / (1.0 + exp(-logit)), 6) AS p1, CASE WHEN logit > 0 THEN 1 ELSE 0 END AS pred,
  CASE WHEN logit > 0 THEN 'toxic' ELSE 'non_toxic' END AS label_name FROM sc""",
)
def q_predict_label(spark, sf):
    lab, w, prior = scorer(spark, sf)
    s = MD.predict_label(MD.log_odds_scores(lab.select("id", "text"), w, prior))
    return s.select("id", F.round("p1", 6).alias("p1"), "pred", "label_name")


@query("train_classifier")
def q_train_classifier(spark, sf):
    lab = X.labelled(spark, sf).withColumnRenamed("toxic", "y")
    split = SM.stratified_split(lab.select("id", "y"), "y", (0.8, 0.1, 0.1), seed=40).select("id", "split")
    d = lab.join(split, "id")
    pred = MD.train_classifier(d.where("split = 'train'"), d.where("split <> 'train'"), "y", "quality")
    return pred.select("id", "y", F.round("l0", 6).alias("l0"), F.round("l1", 6).alias("l1"))
