"""Registered queries: ranks, running sums and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import windows as W
from ..sources import fixtures as X
from . import sql as S
from .registry import query

_P = S.with_(S.LABELLED, S.PREDICTIONS)


@query(
    "midrank",
    _P + """SELECT id, lang, p,
  rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS midrank FROM predictions""",
)
def q_midrank(spark, sf):
    pred = X.predictions(spark, sf).select("id", "lang", "p")
    return W.midrank(pred, "p", ("lang",)).select("id", "lang", "p", "midrank")


@query(
    "midrank_weighted",
    _P + """, cw AS (SELECT y, (SELECT count(*) FROM predictions) / (2.0 * count(*)) AS w FROM predictions GROUP BY y),
c AS (SELECT p.id, p.lang, p.p, sum(cw.w) OVER (PARTITION BY p.lang ORDER BY p.p, p.id ROWS UNBOUNDED PRECEDING) AS cw
      FROM predictions p JOIN cw ON p.y = cw.y)
SELECT id, lang, p, round(avg(cw) OVER (PARTITION BY lang, p), 6) AS midrank_w FROM c""",
)
def q_midrank_weighted(spark, sf):
    pred = X.predictions(spark, sf)
    cw = M.class_weights(pred, "y").select("y", F.col("weight").alias("w"))
    r = W.midrank_weighted(pred.join(cw, "y").select("id", "lang", "p", "w"), "p", "w", "id", ("lang",))
    return r.select("id", "lang", "p", F.round("midrank_w", 6).alias("midrank_w"))


_ROC = """per AS (SELECT lang, p, sum(y) AS pos, sum(1 - y) AS neg FROM predictions GROUP BY lang, p),
c AS (SELECT lang, p AS threshold,
  sum(pos) OVER (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(neg) OVER (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp,
  sum(pos) OVER (PARTITION BY lang) AS P, sum(neg) OVER (PARTITION BY lang) AS N FROM per)"""


@query(
    "roc_curve",
    _P + "," + _ROC + """\nSELECT lang, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  round(CASE WHEN P > 0 THEN tp / P END, 6) AS tpr, round(CASE WHEN N > 0 THEN fp / N END, 6) AS fpr FROM c""",
)
def q_roc_curve(spark, sf):
    r = W.roc_curve(X.predictions(spark, sf), "p", "y", ("lang",))
    return r.select("lang", "threshold", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(
    "pr_curve_auc",
    _P + "," + _ROC + """,
pts AS (SELECT lang, threshold, tp / (tp + fp) AS precision, CASE WHEN P > 0 THEN tp / P END AS recall,
  row_number() OVER (PARTITION BY lang ORDER BY threshold DESC) AS k FROM c)
SELECT a.lang, round(sum((a.recall - coalesce(b.recall, 0.0)) * (a.precision + coalesce(b.precision, 1.0)) / 2.0), 6) AS pr_auc,
  count(*) AS n_points
FROM pts a LEFT JOIN pts b ON a.lang = b.lang AND b.k = a.k - 1 GROUP BY a.lang""",
)
def q_pr_curve_auc(spark, sf):
    pts, area = W.pr_curve_auc(X.predictions(spark, sf), "p", "y", ("lang",))
    n = pts.groupBy("lang").agg(F.count(F.lit(1)).alias("n_points"))
    return area.join(n, "lang").select("lang", F.round("pr_auc", 6).alias("pr_auc"), "n_points")
