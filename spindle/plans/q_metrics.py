"""Registered queries: classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import fixtures as X
from . import sql as S
from .registry import query

G = ("lang",)
_P = S.with_(S.LABELLED, S.PREDICTIONS)


def _conf_sql(weighted: bool = False) -> str:
    w = "w" if weighted else "1"
    cast = (lambda e: e) if weighted else (lambda e: f"CAST({e} AS BIGINT)")
    return f"""conf AS (SELECT lang,
  {cast(f"sum(CASE WHEN y = 1 AND l1 > l0 THEN {w} ELSE 0 END)")} AS tp,
  {cast(f"sum(CASE WHEN y = 0 AND l1 > l0 THEN {w} ELSE 0 END)")} AS fp,
  {cast(f"sum(CASE WHEN y = 0 AND NOT (l1 > l0) THEN {w} ELSE 0 END)")} AS tn,
  {cast(f"sum(CASE WHEN y = 1 AND NOT (l1 > l0) THEN {w} ELSE 0 END)")} AS fn
  FROM {'wpred' if weighted else 'predictions'} GROUP BY lang)"""


def _sd(a, b):
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE 0.0 END)"


_N = "(tp + fp + tn + fn)"
_TPR, _TNR = _sd("tp", "tp + fn"), _sd("tn", "tn + fp")
_PR1, _PR0 = _sd("tp", "tp + fp"), _sd("tn", "tn + fn")
_F1_1 = _sd(f"2 * {_PR1} * {_TPR}", f"{_PR1} + {_TPR}")
_F1_0 = _sd(f"2 * {_PR0} * {_TNR}", f"{_PR0} + {_TNR}")
_PO = f"((tp + tn) / {_N})"
_PE = f"(((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ({_N} * {_N}))"
_BASE = f"((tp + fn) / {_N})"
RATES = {
    "accuracy": _PO,
    "balanced_accuracy": f"(({_TPR} + {_TNR}) / 2.0)",
    "precision_w": f"(({_PR1} * (tp + fn) + {_PR0} * (tn + fp)) / {_N})",
    "recall_w": f"(({_TPR} * (tp + fn) + {_TNR} * (tn + fp)) / {_N})",
    "f1_w": f"(({_F1_1} * (tp + fn) + {_F1_0} * (tn + fp)) / {_N})",
    "kappa": f"(CASE WHEN {_PE} <> 1 THEN ({_PO} - {_PE}) / (1.0 - {_PE}) ELSE 0.0 END)",
    "auc_hard": f"(({_TPR} + {_TNR}) / 2.0)",
    "auc_prc_hard": f"(CASE WHEN tp + fp > 0 THEN {_TPR} * (1.0 + {_PR1}) / 2.0 + (1.0 - {_TPR}) * ({_PR1} + {_BASE}) / 2.0 ELSE (1.0 + {_BASE}) / 2.0 END)",
}


def _rates_query(keys):
    def build(spark, sf):
        r = M.rates(M.confusion(X.predictions(spark, sf), G))
        return r.select("lang", *[F.round(k, 6).alias(k) for k in keys])

    sql = _P + "," + _conf_sql() + "\nSELECT lang, " + ", ".join(f"round({RATES[k]}, 6) AS {k}" for k in keys) + " FROM conf"
    return build, sql


@query("m_confusion", _P + "," + _conf_sql() + "\nSELECT lang, tp, fp, tn, fn FROM conf")
def q_confusion(spark, sf):
    return M.confusion(X.predictions(spark, sf), G)


for _key, _cols in (
    ("m_accuracy_balanced", ["accuracy", "balanced_accuracy"]),
    ("m_prf_weighted", ["precision_w", "recall_w", "f1_w"]),
    ("m_kappa", ["kappa"]),
    ("m_auc_hard", ["auc_hard"]),
    ("m_auc_prc_hard", ["auc_prc_hard"]),
):
    _b, _s = _rates_query(_cols)
    query(_key, _s)(_b)


_CW_SQL = """cw AS (SELECT y, count(*) AS n_c, (SELECT count(*) FROM predictions) / (2.0 * count(*)) AS weight
  FROM predictions GROUP BY y)"""


@query(
    "class_weights",
    _P + "," + """per AS (SELECT lang, y, count(*) AS n_c FROM predictions GROUP BY lang, y),
tot AS (SELECT lang, sum(n_c) AS n, count(*) AS k FROM per GROUP BY lang)
SELECT per.lang, per.y, per.n_c, round(tot.n / (tot.k * per.n_c), 6) AS weight FROM per JOIN tot ON per.lang = tot.lang""",
)
def q_class_weights(spark, sf):
    cw = M.class_weights(X.predictions(spark, sf), "y", G)
    return cw.select("lang", "y", "n_c", F.round("weight", 6).alias("weight"))


def _weighted_pred(spark, sf):
    pred = X.predictions(spark, sf)
    cw = M.class_weights(pred, "y").select("y", F.col("weight").alias("w"))
    return pred.join(cw, "y")


@query(
    "m_sample_weight",
    _P + "," + _CW_SQL + "\nSELECT p.id, p.y, round(cw.weight, 6) AS w FROM predictions p JOIN cw ON p.y = cw.y",
)
def q_sample_weight(spark, sf):
    return _weighted_pred(spark, sf).select("id", "y", F.round("w", 6).alias("w"))


@query(
    "m_confusion_weighted",
    _P + "," + _CW_SQL + ",\nwpred AS (SELECT p.*, cw.weight AS w FROM predictions p JOIN cw ON p.y = cw.y),\n" + _conf_sql(True)
    + "\nSELECT lang, round(tp, 6) AS tp, round(fp, 6) AS fp, round(tn, 6) AS tn, round(fn, 6) AS fn,"
    + f" round({RATES['kappa']}, 6) AS kappa_w FROM conf",
)
def q_confusion_weighted(spark, sf):
    r = M.rates(M.confusion(_weighted_pred(spark, sf), G, weight="w"))
    return r.select("lang", *[F.round(c, 6).alias(c) for c in ("tp", "fp", "tn", "fn")], F.round("kappa", 6).alias("kappa_w"))


_MIDRANKS = """r AS (SELECT lang, id, y, p,
  rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS tz,
  rank() OVER (PARTITION BY lang, y ORDER BY p) + (count(*) OVER (PARTITION BY lang, y, p) - 1) / 2.0 AS tc
  FROM predictions),
mn AS (SELECT lang, CAST(sum(y) AS DOUBLE) AS m, CAST(sum(1 - y) AS DOUBLE) AS n FROM predictions GROUP BY lang),
dl AS (SELECT r.lang, mn.m, mn.n, sum(CASE WHEN y = 1 THEN tz END) AS sz,
  var_samp(CASE WHEN y = 1 THEN (tz - tc) / mn.n END) AS v01,
  var_samp(CASE WHEN y = 0 THEN 1.0 - (tz - tc) / mn.m END) AS v10
  FROM r JOIN mn ON r.lang = mn.lang GROUP BY r.lang, mn.m, mn.n),
auc AS (SELECT lang, CAST(m AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg,
  CASE WHEN m > 0 AND n > 0 THEN sz / m / n - (m + 1.0) / 2.0 / n END AS auc,
  CASE WHEN m > 0 AND n > 0 THEN v01 / m + v10 / n END AS auc_var FROM dl)"""


@query(
    "m_auc_delong",
    _P + "," + _MIDRANKS + "\nSELECT lang, n_pos, n_neg, round(auc, 6) AS auc, round(auc_var, 9) AS auc_var FROM auc",
)
def q_auc_delong(spark, sf):
    d = M.delong(X.predictions(spark, sf), "p", G)
    return d.select("lang", "n_pos", "n_neg", F.round("auc", 6).alias("auc"), F.round("auc_var", 9).alias("auc_var"))


@query(
    "m_auc_delong_ci",
    _P + "," + _MIDRANKS
    + f"""\nSELECT lang, round(auc, 6) AS auc, round(auc - {M.Z_975} * sqrt(auc_var), 6) AS auc_lb,
  round(least(1.0, auc + {M.Z_975} * sqrt(auc_var)), 6) AS auc_ub FROM auc""",
)
def q_auc_delong_ci(spark, sf):
    d = M.delong_ci(M.delong(X.predictions(spark, sf), "p", G))
    return d.select("lang", *[F.round(c, 6).alias(c) for c in ("auc", "auc_lb", "auc_ub")])


def _erfc_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 5e-1 * {x}))"
    poly = f"{M.ERFC_COEFFS[-1]!r}e0"
    for c in reversed(M.ERFC_COEFFS[:-1]):
        poly = f"({c!r}e0 + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def _ranks(col: str, sfx: str) -> str:
    return (
        f"rank() OVER (PARTITION BY lang ORDER BY {col}) + (count(*) OVER (PARTITION BY lang, {col}) - 1) / 2.0 AS tz{sfx}, "
        f"rank() OVER (PARTITION BY lang, y ORDER BY {col}) + (count(*) OVER (PARTITION BY lang, y, {col}) - 1) / 2.0 AS tc{sfx}"
    )


_DELONG_TEST = (
    _P
    + f""", r AS (SELECT lang, id, y, {_ranks('p', 'a')}, {_ranks('p2', 'b')} FROM predictions),
mn AS (SELECT lang, CAST(sum(y) AS DOUBLE) AS m, CAST(sum(1 - y) AS DOUBLE) AS n FROM predictions GROUP BY lang),
v AS (SELECT r.lang, m, n,
  CASE WHEN y = 1 THEN (tza - tca) / n END AS v01a, CASE WHEN y = 0 THEN 1.0 - (tza - tca) / m END AS v10a,
  CASE WHEN y = 1 THEN (tzb - tcb) / n END AS v01b, CASE WHEN y = 0 THEN 1.0 - (tzb - tcb) / m END AS v10b,
  CASE WHEN y = 1 THEN tza END AS sza, CASE WHEN y = 1 THEN tzb END AS szb FROM r JOIN mn ON r.lang = mn.lang),
ag AS (SELECT lang, max(m) AS m, max(n) AS n, sum(sza) AS sza, sum(szb) AS szb, var_samp(v01a) AS va01, var_samp(v10a) AS va10,
  var_samp(v01b) AS vb01, var_samp(v10b) AS vb10, covar_samp(v01a, v01b) AS c01, covar_samp(v10a, v10b) AS c10 FROM v GROUP BY lang),
zz AS (SELECT lang, sza / (m * n) - (m + 1.0) / (2.0 * n) AS a1, szb / (m * n) - (m + 1.0) / (2.0 * n) AS a2,
  (va01 + vb01 - 2 * c01) / m + (va10 + vb10 - 2 * c10) / n AS vd FROM ag),
zs AS (SELECT lang, a1, a2, (a1 - a2) / sqrt(vd) AS z FROM zz)
SELECT lang, round(a1, 6) AS auc_1, round(a2, 6) AS auc_2, round(z, 6) AS z,
  round(log10({_erfc_sql("abs(z) / sqrt(2.0)")}), 6) AS log10_p FROM zs"""
)


@query("m_delong_test", _DELONG_TEST)
def q_delong_test(spark, sf):
    t = M.delong_test(X.predictions(spark, sf), "p", "p2", G)
    return t.select("lang", *[F.round(c, 6).alias(c) for c in ("auc_1", "auc_2", "z", "log10_p")])


_LL = """ll AS (SELECT lang, -ln(greatest(CASE WHEN y = 1 THEN 1.0 / (1.0 + exp(l0 - l1)) ELSE 1.0 - 1.0 / (1.0 + exp(l0 - l1)) END, 1e-15)) AS nll
  FROM predictions)"""


_T975 = "CASE WHEN count(*) > 1 THEN " + " + ".join([str(M.Z_975), *(f"{c} / pow(count(*) - 1, {k})" for k, c in enumerate(M.T_SERIES, 1))]) + " END"


@query(
    "m_logloss_ppl",
    _P + "," + _LL + """\nSELECT lang, count(*) AS n, round(avg(nll), 6) AS logloss, round(stddev_samp(nll) / sqrt(count(*)), 6) AS sem,
  round(exp(avg(nll)), 6) AS perplexity, round(avg(nll) - """ + _T975 + """ * stddev_samp(nll) / sqrt(count(*)), 6) AS logloss_lb,
  round(avg(nll) + """ + _T975 + """ * stddev_samp(nll) / sqrt(count(*)), 6) AS logloss_ub,
  round(exp(avg(nll) - """ + _T975 + """ * stddev_samp(nll) / sqrt(count(*))), 6) AS perplexity_lb,
  round(exp(avg(nll) + """ + _T975 + """ * stddev_samp(nll) / sqrt(count(*))), 6) AS perplexity_ub,
  round(exp(avg(nll) / count(*)), 6) AS smoothed_perplexity FROM ll GROUP BY lang""",
)
def q_logloss(spark, sf):
    r = M.logloss_ppl(X.predictions(spark, sf), G)
    cols = ("logloss", "sem", "perplexity", "logloss_lb", "logloss_ub", "perplexity_lb", "perplexity_ub", "smoothed_perplexity")
    return r.select("lang", "n", *[F.round(c, 6).alias(c) for c in cols])


_ALL_COLS = ["accuracy", "balanced_accuracy", "precision_w", "recall_w", "f1_w", "kappa", "auc_hard", "auc_prc_hard"]


@query(
    "m_all",
    _P + "," + _conf_sql() + "," + _MIDRANKS + "," + _LL
    + "\nSELECT c.lang, c.tp, c.fp, c.tn, c.fn, "
    + ", ".join(f"round({RATES[k]}, 6) AS {k}" for k in _ALL_COLS)
    + """, round(a.auc, 6) AS auc, round(a.auc_var, 9) AS auc_var, round(l.logloss, 6) AS logloss
FROM conf c JOIN auc a ON c.lang = a.lang JOIN (SELECT lang, avg(nll) AS logloss FROM ll GROUP BY lang) l ON c.lang = l.lang""",
)
def q_all(spark, sf):
    pred = X.predictions(spark, sf)
    r = M.rates(M.confusion(pred, G))
    d = M.delong(pred, "p", G)
    ll = M.logloss_ppl(pred, G)
    return (
        r.join(d, "lang")
        .join(ll, "lang")
        .select(
            "lang", "tp", "fp", "tn", "fn",
            *[F.round(c, 6).alias(c) for c in _ALL_COLS],
            F.round("auc", 6).alias("auc"),
            F.round("auc_var", 9).alias("auc_var"),
            F.round("logloss", 6).alias("logloss"),
        )
    )


_WEIGHTED_TAIL = (
    ", round(a.auc, 6) AS auc, round(a.auc - " + f"{M.Z_975}" + " * sqrt(a.auc_var), 6) AS auc_lb, round(least(1e0, a.auc + "
    + f"{M.Z_975}" + """ * sqrt(a.auc_var)), 6) AS auc_ub, round(l.logloss, 6) AS logloss, round(exp(l.logloss), 6) AS perplexity,
  round(exp(l.logloss - l.half), 6) AS perplexity_lb, round(exp(l.logloss + l.half), 6) AS perplexity_ub
FROM conf c JOIN auc a ON c.lang = a.lang
JOIN (SELECT lang, avg(nll) AS logloss, """ + _T975 + """ * stddev_samp(nll) / sqrt(count(*)) AS half FROM ll GROUP BY lang) l ON c.lang = l.lang"""
)


@query(
    "m_all_weighted",
    _P + "," + _CW_SQL + ",\nwpred AS (SELECT p.*, cw.weight AS w FROM predictions p JOIN cw ON p.y = cw.y),\n" + _conf_sql(True) + "," + _MIDRANKS + "," + _LL
    + "\nSELECT c.lang, " + ", ".join(f"round(c.{k}, 6) AS {k}" for k in ("tp", "fp", "tn", "fn")) + ", "
    + ", ".join(f"round({RATES[k]}, 6) AS {k}" for k in _ALL_COLS) + _WEIGHTED_TAIL,
)
def q_all_weighted(spark, sf):
    """All metrics with balanced class weights on the counts; AUC with its interval, loss and perplexity are of the rows as they are."""
    pred = X.predictions(spark, sf)
    r = M.rates(M.confusion(_weighted_pred(spark, sf), G, weight="w"))
    d = M.delong_ci(M.delong(pred, "p", G)).select("lang", "auc", "auc_lb", "auc_ub")
    ll = M.logloss_ppl(pred, G).select("lang", "logloss", "perplexity", "perplexity_lb", "perplexity_ub")
    rest = ("auc", "auc_lb", "auc_ub", "logloss", "perplexity", "perplexity_lb", "perplexity_ub")
    return r.join(d, "lang").join(ll, "lang").select("lang", *[F.round(c, 6).alias(c) for c in ("tp", "fp", "tn", "fn", *_ALL_COLS, *rest)])
