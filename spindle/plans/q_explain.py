"""Registered queries: attributions and explanation quality.

The explained rows are the labelled documents; the model is the log-odds
scorer trained on them.  Every attribution method runs twice (rep 0, 1);
the sampled method draws 16 masks per row and repetition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import explain as EX
from ..operators import joins as J
from ..operators import model as MD
from ..operators import quality as Q
from ..operators import rowwise as RW
from ..operators import sample as SM
from ..operators.util import written
from ..sources import fixtures as X
from . import sql as S
from .q_models import LOG_ODDS, scorer
from .registry import query

REPS, SAMPLES, SEED = 2, 16, 42
#: Perturbed copies of each row for the Lipschitz constants, as in the reference's evaluate_fairness.
PERTURBATIONS = 10
KEY = ["id"]


def _setup(spark, sf):
    """Labelled rows, weights, prior, the rows' tokens (written once) and these with their weights."""
    lab, w, prior = scorer(spark, sf)
    rows = written(RW.with_words(RW.token_rows(lab.select("id", "text"), KEY), KEY), "token-rows")
    return lab, w, prior, rows, RW.weighted_rows(rows, KEY, w)


def _positions_table(spark, sf):
    """The tokens of every row with their weights, a row for each position."""
    lab, w, _ = scorer(spark, sf)
    return written(MD.token_weights(lab.select("id", "text"), w), "token-weights")


def _attr(spark, sf, reps=REPS):
    _, _, prior, _, tw = _setup(spark, sf)
    return EX.explain_all_methods(tw, KEY, prior, reps, SAMPLES, SEED)


def _measures(tw, prior, *wanted):
    """Measures of all rows and methods, written once: logits and every metric are made from them."""
    return written(Q.row_measures(tw, KEY, prior, wanted, samples=SAMPLES, seed=SEED), "row-measures")


def _logits(lab, w, prior, measures):
    sums = measures.where(F.col("method") == EX.METHODS[0]).select("id", F.col("total").alias("_s"))
    return MD.log_odds_scores(lab.select("id", "y"), w, prior, sums=sums).select("id", "y", "logit")


_ATTR_SQL = LOG_ODDS + f""",
tww AS (SELECT t.id, t.pos, t.token, coalesce(w.w, 0.0) AS w FROM (SELECT id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS token
   FROM (SELECT id, regexp_extract_all(lower(text), '{S.WORD_RE}', 1) AS x FROM labelled)) t LEFT JOIN w ON w.token = t.token),
reps AS (SELECT rep FROM range(0, {REPS}) r(rep)),
ig AS (SELECT 'ig' AS method, id, rep, pos, token, CASE WHEN nrm > 0 THEN w / nrm ELSE 0.0 END AS score
   FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS nrm FROM tww), reps),
means AS (SELECT token, count(*) / (SELECT count(DISTINCT id) FROM tww) AS mean_x FROM tww GROUP BY token),
shap_t AS (SELECT c.id, c.token, c.w * (c.x - coalesce(m.mean_x, 0.0)) AS score FROM
   (SELECT id, token, count(*) AS x, first(w) AS w FROM tww GROUP BY id, token) c LEFT JOIN means m ON m.token = c.token),
shap AS (SELECT 'shap' AS method, t.id, rep, t.pos, t.token, coalesce(s.score, 0.0) AS score FROM tww t
   LEFT JOIN shap_t s ON s.id = t.id AND s.token = t.token, reps),
occ_t AS (SELECT id, token, count(*) * first(w) AS score FROM tww GROUP BY id, token),
occ AS (SELECT 'occlusion' AS method, t.id, rep, t.pos, t.token, coalesce(o.score, 0.0) AS score FROM tww t
   LEFT JOIN occ_t o ON o.id = t.id AND o.token = t.token, reps),
ts AS (SELECT t.id, t.pos, t.token, t.w, r.rep, s.s,
   ({S.md5_int(f"'{SEED}:' || r.rep || ':' || t.id || ':' || (s.s // 32) || ':' || t.pos")} >> (s.s % 32)) & 1 AS bit
   FROM tww t, reps r, range(0, {SAMPLES}) s(s)),
ss AS (SELECT id, rep, s, (SELECT prior FROM prior) + sum(w * bit) AS sc FROM ts GROUP BY id, rep, s),
eff AS (SELECT ts.id, ts.rep, ts.pos, ts.token,
   coalesce(avg(CASE WHEN bit = 1 THEN sc END) - avg(CASE WHEN bit = 0 THEN sc END), 0.0) AS e
   FROM ts JOIN ss ON ss.id = ts.id AND ss.rep = ts.rep AND ss.s = ts.s GROUP BY ts.id, ts.rep, ts.pos, ts.token),
smp AS (SELECT 'sampled' AS method, id, rep, pos, token, e - avg(e) OVER (PARTITION BY id, rep) AS score FROM eff),
attr AS (SELECT * FROM ig UNION ALL SELECT * FROM shap UNION ALL SELECT * FROM occ UNION ALL SELECT * FROM smp),
rk AS (SELECT method, id, rep, pos, token, score, row_number() OVER (PARTITION BY method, id, rep ORDER BY score DESC, pos) AS rnk,
   count(*) OVER (PARTITION BY method, id, rep) AS n FROM attr),
top AS (SELECT DISTINCT method, id, token FROM rk WHERE rep = 0 AND rnk <= greatest(1, floor(n * 4e-1)))
"""


def _positions(method):
    return _ATTR_SQL + f"SELECT id, pos, token, round(score, 6) AS score FROM {method} WHERE rep = 0"


@query("attr_ig_linear", _positions("ig"))
def q_attr_ig(spark, sf):
    tw = _positions_table(spark, sf)
    a = EX.attr_ig_linear(tw, KEY, 1)
    return a.select("id", "pos", "token", F.round("score", 6).alias("score"))


@query("attr_shap_linear", _positions("shap"))
def q_attr_shap(spark, sf):
    tw = _positions_table(spark, sf)
    a = EX.attr_shap_linear(tw, KEY, EX.token_means(tw, KEY), 1)
    return a.select("id", "pos", "token", F.round("score", 6).alias("score"))


@query("attr_occlusion", _positions("occ"))
def q_attr_occlusion(spark, sf):
    tw = _positions_table(spark, sf)
    a = EX.attr_occlusion(tw, KEY, 1)
    return a.select("id", "pos", "token", F.round("score", 6).alias("score"))


@query(
    "attr_sampled",
    _ATTR_SQL + "SELECT id, rep, count(*) AS n, round(sum(abs(score)), 4) AS sum_abs, round(max(score), 4) AS max_score FROM smp GROUP BY id, rep",
)
def q_attr_sampled(spark, sf):
    _, _, prior, _, tw = _setup(spark, sf)
    a = EX.attr_sampled(tw, KEY, prior, SAMPLES, REPS, SEED)
    return a.groupBy("id", F.col("rep").cast("bigint").alias("rep")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("score")), 4).alias("sum_abs"), F.round(F.max("score"), 4).alias("max_score")
    )


@query(
    "explain_all_methods",
    _ATTR_SQL + "SELECT method, rep, count(*) AS n, round(sum(abs(score)), 4) AS sum_abs FROM attr GROUP BY method, rep",
)
def q_explain_all(spark, sf):
    a = _attr(spark, sf)
    return a.groupBy("method", F.col("rep").cast("bigint").alias("rep")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("score")), 4).alias("sum_abs")
    )


@query(
    "duplicate_token_restore",
    _ATTR_SQL + "SELECT id, count(*) AS n_positions, count(DISTINCT token) AS n_tokens, round(sum(score), 2) AS total FROM occ WHERE rep = 0 GROUP BY id",
)
def q_duplicate_token_restore(spark, sf):
    tw = _positions_table(spark, sf)
    per = tw.groupBy("id", "token").agg((F.count(F.lit(1)) * F.first("w")).alias("score"))
    r = EX.duplicate_token_restore(tw, per, KEY)
    return r.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_positions"), F.countDistinct("token").alias("n_tokens"), F.round(F.sum("score"), 2).alias("total")
    )


@query("rank_explanations", _ATTR_SQL + "SELECT id, pos, rnk AS rank FROM rk WHERE method = 'ig' AND rep = 0")
def q_rank_explanations(spark, sf):
    tw = _positions_table(spark, sf)
    r = EX.rank_explanations(EX.attr_ig_linear(tw, KEY, 1), KEY)
    return r.select("id", "pos", F.col("rank").cast("bigint").alias("rank"))


@query("topk_fraction", _ATTR_SQL + "SELECT id, pos FROM rk WHERE method = 'ig' AND rep = 0 AND rnk <= greatest(1, floor(n * 4e-1))")
def q_topk_fraction(spark, sf):
    tw = _positions_table(spark, sf)
    return EX.top_fraction(EX.attr_ig_linear(tw, KEY, 1), KEY, 0.4).select("id", "pos")


@query(
    "attr_matrix",
    _ATTR_SQL
    + """SELECT id, token, round(coalesce(sum(score) FILTER (WHERE method = 'ig'), 0.0), 6) AS ig,
  round(coalesce(sum(score) FILTER (WHERE method = 'shap'), 0.0), 6) AS shap,
  round(coalesce(sum(score) FILTER (WHERE method = 'occlusion'), 0.0), 6) AS occlusion,
  round(coalesce(sum(score) FILTER (WHERE method = 'sampled'), 0.0), 4) AS sampled FROM attr WHERE rep = 0 GROUP BY id, token""",
)
def q_attr_matrix(spark, sf):
    _, _, prior, _, tw = _setup(spark, sf)
    m = EX.attr_matrix(tw, KEY, prior, samples=SAMPLES, seed=SEED)
    return m.select("id", "token", *[F.round(c, 6).alias(c) for c in ("ig", "shap", "occlusion")], F.round("sampled", 4).alias("sampled"))


# --- quality ------------------------------------------------------------------------------------

_FAITH_ROWS = """, rmv AS (SELECT t.method, t.id, sum(tww.w) AS rm FROM top t JOIN tww ON tww.id = t.id AND tww.token = t.token GROUP BY t.method, t.id),
fw AS (SELECT t.method, t.id, sc.y, sc.logit, sc.logit - coalesce(rmv.rm, 0.0) AS weak FROM (SELECT DISTINCT method, id FROM top) t
   JOIN sc ON sc.id = t.id LEFT JOIN rmv ON rmv.method = t.method AND rmv.id = t.id),
fr AS (SELECT method, id, y, abs(greatest(1.0 / (1.0 + exp(-logit)), 1.0 - 1.0 / (1.0 + exp(-logit)))
   - CASE WHEN (logit > 0) <> (weak > 0) THEN -1.0 ELSE 1.0 END * greatest(1.0 / (1.0 + exp(-weak)), 1.0 - 1.0 / (1.0 + exp(-weak)))) AS faith FROM fw)
"""


def _faithfulness(spark, sf):
    lab, w, prior, _, tw = _setup(spark, sf)
    m = _measures(tw, prior, "removed")
    return Q.faithfulness(m, _logits(lab, w, prior, m), KEY)


@query(
    "q_faithfulness",
    _ATTR_SQL + _FAITH_ROWS + "SELECT method, count(*) AS n, round(avg(faith), 6) AS faithfulness, round(stddev_pop(faith), 6) AS std FROM fr GROUP BY method",
)
def q_faithfulness(spark, sf):
    f = _faithfulness(spark, sf)
    return f.select("method", "n", F.round("faithfulness", 6).alias("faithfulness"), F.round("std", 6).alias("std"))


@query(
    "q_reiteration",
    _ATTR_SQL
    + """, b AS (SELECT method, id, rep, pos, CASE WHEN score > 0 THEN 1 ELSE 0 END AS b FROM attr),
pr AS (SELECT x.method, x.id, x.rep AS r1, y.rep AS r2,
   sum(CASE WHEN x.b = 1 AND y.b = 1 THEN 1 ELSE 0 END) AS both_, sum(CASE WHEN x.b = 1 OR y.b = 1 THEN 1 ELSE 0 END) AS either_
   FROM b x JOIN b y ON x.method = y.method AND x.id = y.id AND x.pos = y.pos AND x.rep < y.rep GROUP BY 1, 2, 3, 4),
jj AS (SELECT method, CASE WHEN either_ > 0 THEN both_ / either_ END AS jac FROM pr)
SELECT method, round(avg(jac), 6) AS mean_jaccard, round(stddev_pop(jac), 6) AS std_jaccard FROM jj GROUP BY method""",
)
def q_reiteration(spark, sf):
    _, _, prior, _, tw = _setup(spark, sf)
    r = Q.reiteration(tw, KEY, prior, REPS, SAMPLES, SEED)
    return r.select("method", F.round("mean_jaccard", 6).alias("mean_jaccard"), F.round("std_jaccard", 6).alias("std_jaccard"))


@query(
    "q_cross_method_jaccard",
    _ATTR_SQL
    + """, b AS (SELECT method, id, rep, pos, CASE WHEN score > 0 THEN 1 ELSE 0 END AS b FROM attr),
pr AS (SELECT x.id, x.rep AS r1, y.rep AS r2,
   sum(CASE WHEN x.b = 1 AND y.b = 1 THEN 1 ELSE 0 END) AS both_, sum(CASE WHEN x.b = 1 OR y.b = 1 THEN 1 ELSE 0 END) AS either_
   FROM b x JOIN b y ON x.id = y.id AND x.pos = y.pos WHERE x.method = 'ig' AND y.method = 'sampled' GROUP BY 1, 2, 3)
SELECT 'ig' AS method_1, 'sampled' AS method_2, round(avg(CASE WHEN either_ > 0 THEN both_ / either_ END), 6) AS mean_jaccard, count(*) AS n_pairs FROM pr""",
)
def q_cross_method_jaccard(spark, sf):
    _, _, prior, _, tw = _setup(spark, sf)
    r = Q.cross_method_jaccard(tw, KEY, prior, "ig", "sampled", REPS, SAMPLES, SEED)
    return r.select("method_1", "method_2", F.round("mean_jaccard", 6).alias("mean_jaccard"), "n_pairs")


_EFFECTS = """, imp AS (SELECT method, id, token, max(score) AS importance FROM attr WHERE rep = 0 GROUP BY method, id, token),
dl AS (SELECT id, token, sum(w) AS delta FROM tww GROUP BY id, token),
te AS (SELECT imp.method, imp.id, imp.token, imp.importance, dl.delta FROM imp JOIN dl ON dl.id = imp.id AND dl.token = imp.token)
"""


@query(
    "q_basic_fidelity",
    _ATTR_SQL + _EFFECTS + "SELECT method, round(avg(abs(delta) * abs(importance)), 4) AS basic_fidelity FROM te GROUP BY method",
)
def q_basic_fidelity(spark, sf):
    _, _, prior, _, tw = _setup(spark, sf)
    return Q.basic_fidelity(tw, KEY, prior, SAMPLES, SEED).select("method", F.round("basic_fidelity", 4).alias("basic_fidelity"))


@query(
    "q_pearson_fidelity",
    _ATTR_SQL + _EFFECTS + "SELECT method, round(corr(importance, delta), 4) AS pearson_fidelity, count(*) AS n FROM te GROUP BY method",
)
def q_pearson_fidelity(spark, sf):
    _, _, prior, _, tw = _setup(spark, sf)
    return Q.pearson_fidelity(tw, KEY, prior, SAMPLES, SEED).select("method", F.round("pearson_fidelity", 4).alias("pearson_fidelity"), "n")


def _toxic_alerts(spark, sf):
    rows = X.labelled(spark, sf).select("id", "text", F.col("toxic").alias("label"))
    return A.structural_alerts(rows).select("token")


_ALERTS_SQL = f""", pw AS (SELECT unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1)) AS token FROM labelled WHERE toxic = 1),
cand AS (SELECT token, count(*) AS tp FROM pw WHERE length(token) BETWEEN 2 AND 40 GROUP BY token HAVING count(*) >= 3),
fpc AS (SELECT c.token, count(n.id) AS fp FROM cand c LEFT JOIN labelled n ON n.toxic = 0 AND contains(lower(n.text), c.token) GROUP BY c.token),
alerts AS (SELECT c.token FROM cand c JOIN fpc f ON c.token = f.token WHERE c.tp / (c.tp + f.fp) > 0.5)
"""


@query(
    "q_alerts_intersection",
    _ATTR_SQL + _ALERTS_SQL
    + """, pos AS (SELECT DISTINCT method, token FROM attr WHERE rep = 0 AND score > 0)
SELECT method, count(*) AS n_positive, count(a.token) AS n_alerts, round(count(a.token) / count(*), 6) AS share
FROM pos LEFT JOIN alerts a ON a.token = pos.token GROUP BY method""",
)
def q_alerts_intersection(spark, sf):
    r = Q.alerts_intersection(_attr(spark, sf, 1), _toxic_alerts(spark, sf))
    return r.select("method", "n_positive", "n_alerts", F.round("share", 6).alias("share"))


# Simpson's rule for the tail of Student's t (cos^(df - 1) from A0).
_TAIL = f"""(list_sum(list_transform(range(0, {Q.T_STEPS + 1}), lambda i: (CASE WHEN i = 0 OR i = {Q.T_STEPS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)
  * pow(greatest(cos(A0 + (least(pi() / 2, A0 + {Q.T_REACH} / sqrt(df)) - A0) / {Q.T_STEPS} * i), CAST(0 AS DOUBLE)), df - 1)))
  * (least(pi() / 2, A0 + {Q.T_REACH} / sqrt(df)) - A0))"""


@query(
    "q_welch",
    _ATTR_SQL + _FAITH_ROWS
    + """, st AS (SELECT method, avg(faith) FILTER (WHERE y = 1) AS m1, avg(faith) FILTER (WHERE y = 0) AS m0,
   var_samp(faith) FILTER (WHERE y = 1) AS v1, var_samp(faith) FILTER (WHERE y = 0) AS v0,
   count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM fr GROUP BY method)
SELECT method, round(t, 6) AS t, round(df, 6) AS df, n1, n0, round(tail / whole, 6) AS p_value, tail / whole < 0.05 AS significant FROM (
SELECT *, """ + _TAIL.replace("A0", "atan(abs(t) / sqrt(df))") + " AS tail, " + _TAIL.replace("A0", "CAST(0 AS DOUBLE)") + """ AS whole FROM (
SELECT method, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t,
  (v1 / n1 + v0 / n0) * (v1 / n1 + v0 / n0) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v0 / n0) * (v0 / n0) / (n0 - 1)) AS df, n1, n0 FROM st))""",
)
def q_welch(spark, sf):
    lab, w, prior, _, tw = _setup(spark, sf)
    m = _measures(tw, prior, "removed")
    logits = _logits(lab, w, prior, m)
    fr = Q.faithfulness_rows(m, logits, KEY).join(logits.select("id", "y"), "id")
    w = Q.welch(fr, "faith", "y")
    return w.select("method", *[F.round(c, 6).alias(c) for c in ("t", "df", "p_value")], "n1", "n0", "significant")


@query(
    "q_score_report",
    _ATTR_SQL + _FAITH_ROWS
    + """SELECT method, round(avg(faith), 6) AS score, round(1.96e0 * stddev_pop(faith) / sqrt(count(*)), 6) AS margin
FROM fr GROUP BY method ORDER BY score DESC""",
)
def q_score_report(spark, sf):
    f = _faithfulness(spark, sf)
    r = f.select(
        "method", F.round("faithfulness", 6).alias("score"), F.round(F.lit(Q.Z_95) * F.col("std") / F.sqrt("n"), 6).alias("margin")
    )
    return r.orderBy(F.col("score").desc())


# --- quality metrics without an oracle (perturbation re-explanation, similarity pairs) ------------

def _variants(spark, sf, n_pert: int):
    """Labelled rows, weights, prior and the weighted rows with their n keep-90 % perturbations (copies 1..n)."""
    lab, w, prior = scorer(spark, sf)
    rows = written(SM.perturbed_rows(RW.token_rows(lab.select("id", "text"), KEY), reps=n_pert, frac=0.9, seed=SEED), "variant-rows")
    return lab, w, prior, RW.weighted_rows(rows, KEY, w)


@query("q_stability")
def q_stability(spark, sf):
    _, _, prior, tw = _variants(spark, sf, 1)
    s = Q.stability(Q.row_measures(tw, KEY, prior, ("jac",), samples=SAMPLES, seed=SEED))
    return s.select("method", F.round("stability", 6).alias("stability"), "n")


@query("q_lipschitz")
def q_lipschitz(spark, sf):
    _, _, prior, tw = _variants(spark, sf, PERTURBATIONS)
    lip = Q.lipschitz(Q.row_measures(tw, KEY, prior, ("lip",), samples=SAMPLES, seed=SEED), KEY)
    return lip.groupBy("method").agg(F.round(F.avg("lip"), 6).alias("lipschitz"), F.count(F.lit(1)).alias("n"))


@query("q_similar_pairs")
def q_similar_pairs(spark, sf):
    lab = X.labelled(spark, sf)
    sets = lab.select("id", X.T.word_tokens("text").alias("tokens"))
    pairs, _ = J.similarity_self_join(sets, 0.6)
    pairs = written(pairs.select("id_a", "id_b"), "similar-pairs")
    members = written(J.similarity_members(sets), "similar-members")
    _, w, prior, rows, _ = _setup(spark, sf)
    tw = RW.weighted_rows(rows, KEY, w, only=Q.rows_in_pairs(pairs, members))
    r = Q.similar_pairs(Q.rank_vectors(tw, KEY, prior, SAMPLES, SEED), pairs, members=members)
    return r.select("method", F.round("mean_r", 6).alias("mean_r"), F.round("median_r", 6).alias("median_r"), "n_pairs")


def _fairness(spark, sf):
    lab, w, prior, tw = _variants(spark, sf, PERTURBATIONS)
    m = _measures(tw, prior, "removed", "jac", "lip")
    logits = _logits(lab, w, prior, m)
    fr = Q.faithfulness_rows(m, logits, KEY)
    return Q.fairness(fr, Q.lipschitz(m, KEY), logits.select("id", "y")), m


@query("q_fairness")
def q_fairness(spark, sf):
    f, _ = _fairness(spark, sf)
    return f.select("method", *[F.round(c, 6).alias(c) for c in f.columns if c != "method"])


@query("q_fairness_report")
def q_fairness_report(spark, sf):
    f, m = _fairness(spark, sf)
    st = Q.stability(m).select("method", "stability")
    faith = (F.col("faith_0") + F.col("faith_1")) / 2.0
    r = f.join(st, "method").select(
        "method", faith.alias("faithfulness"), (F.lit(1.0) - F.col("stability")).alias("instability"), "fairness"
    ).withColumn("avg_fairness", (F.col("faithfulness") + F.col("instability")) / 2.0)
    return r.select("method", *[F.round(c, 6).alias(c) for c in ("faithfulness", "instability", "fairness", "avg_fairness")]).orderBy(
        F.col("avg_fairness").desc()
    )
