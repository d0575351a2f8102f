"""Registered queries: structural-alert mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators.joins import containment_join
from ..sources import fixtures as X
from . import sql as S
from .registry import query


def _rows(spark, sf, task="toxic"):
    lab = X.labelled(spark, sf)
    return lab.select("id", "text", F.col(task).alias("label"))


def _rows_by_task(spark, sf):
    lab = X.labelled(spark, sf)
    return lab.select("id", "text", "quality", "toxic").unpivot(
        ["id", "text"], ["quality", "toxic"], "task", "label"
    )


def _docs(spark, sf):
    return X.labelled(spark, sf).select("id", "text")


_POS_CAND = S.with_(
    S.LABELLED,
    f"""pw AS (SELECT unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1)) AS token FROM labelled WHERE toxic = 1)""",
    """cand AS (SELECT token, count(*) AS tp FROM pw WHERE length(token) BETWEEN 2 AND 40
             GROUP BY token HAVING count(*) >= 3)""",
    """fp AS (SELECT c.token, count(n.id) AS fp FROM cand c
           LEFT JOIN labelled n ON n.toxic = 0 AND contains(lower(n.text), c.token) GROUP BY c.token)""",
    """scored AS (SELECT c.token, c.tp, f.fp, c.tp / (c.tp + f.fp) AS ppv FROM cand c JOIN fp f ON c.token = f.token)""",
)


@query("alert_candidates", _POS_CAND + "SELECT token, CAST(tp AS BIGINT) AS tp FROM cand")
def q_alert_candidates(spark, sf):
    rows = _rows(spark, sf)
    pos_tok = rows.where("label = 1").select("id", F.explode(X.T.word_tokens("text")).alias("token"))
    return A.alert_candidates(pos_tok).select("token", F.col("tp").cast("bigint").alias("tp"))


@query(
    "alert_ppv",
    _POS_CAND + "SELECT token, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(ppv, 6) AS ppv FROM scored",
)
def q_alert_ppv(spark, sf):
    scored, _ = A.alert_ppv(_rows(spark, sf))
    return scored.select("token", "tp", "fp", F.round("ppv", 6).alias("ppv"))


@query(
    "structural_alerts",
    _POS_CAND
    + "SELECT token, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(ppv, 6) AS ppv FROM scored WHERE ppv > 0.5",
)
def q_structural_alerts(spark, sf):
    return A.structural_alerts(_rows(spark, sf)).select("token", "tp", "fp", F.round("ppv", 6).alias("ppv"))


_ALL_PPV = S.with_(
    S.LABELLED,
    f"""pw AS (SELECT unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1)) AS token FROM labelled WHERE toxic = 1)""",
    """cand AS (SELECT token, count(*) AS tp FROM pw GROUP BY token)""",
    f"""nw AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1)) AS word FROM labelled WHERE toxic = 0)""",
    """places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM (SELECT DISTINCT word FROM nw))""",
    """parts AS (SELECT DISTINCT word, substring(word, i, l) AS token FROM (SELECT word, i, unnest(range(1, length(word) - i + 2)) AS l FROM places))""",
    """fp AS (SELECT c.token, count(DISTINCT nw.id) AS fp FROM cand c JOIN parts p ON p.token = c.token JOIN nw ON nw.word = p.word GROUP BY c.token)""",
    """scored AS (SELECT c.token, c.tp / (c.tp + coalesce(fp.fp, 0)) AS ppv FROM cand c LEFT JOIN fp ON fp.token = c.token)""",
)


@query("mean_ppv", _ALL_PPV + "SELECT round(avg(ppv), 6) AS mean_ppv, count(*) AS n_fragments FROM scored")
def q_mean_ppv(spark, sf):
    """Over all fragments of the positive rows, whatever their count and length."""
    scored, _ = A.alert_ppv(_rows(spark, sf), min_count=1, min_len=1, max_len=2**31 - 1)
    return scored.agg(F.round(F.avg("ppv"), 6).alias("mean_ppv"), F.count(F.lit(1)).alias("n_fragments"))


@query(
    "containment_join",
    _POS_CAND
    + """SELECT c.token, n.id FROM cand c JOIN labelled n ON contains(lower(n.text), c.token)""",
)
def q_containment_join(spark, sf):
    rows = _rows(spark, sf)
    pos_tok = rows.where("label = 1").select("id", F.explode(X.T.word_tokens("text")).alias("token"))
    cands = A.alert_candidates(pos_tok)
    return containment_join(cands.select("token"), rows.select("id", "text")).select("token", "id")


_BY_TASK = S.with_(
    S.LABELLED,
    """r AS (SELECT 'quality' AS task, id, text, quality AS label FROM labelled
          UNION ALL SELECT 'toxic' AS task, id, text, toxic AS label FROM labelled)""",
    f"""pw AS (SELECT task, unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1)) AS token FROM r WHERE label = 1)""",
    """cand AS (SELECT task, token, count(*) AS tp FROM pw WHERE length(token) BETWEEN 2 AND 40
             GROUP BY task, token HAVING count(*) >= 3)""",
    """fp AS (SELECT c.task, c.token, count(n.id) AS fp FROM cand c
           LEFT JOIN r n ON n.task = c.task AND n.label = 0 AND contains(lower(n.text), c.token)
           GROUP BY c.task, c.token)""",
    """scored AS (SELECT c.task, c.token, c.tp, f.fp, c.tp / (c.tp + f.fp) AS ppv
               FROM cand c JOIN fp f ON c.task = f.task AND c.token = f.token)""",
    """alerts AS (SELECT task, token FROM scored WHERE ppv > 0.5)""",
    """hits AS (SELECT DISTINCT p.task, p.id FROM r p JOIN alerts a ON a.task = p.task AND contains(lower(p.text), a.token)
             WHERE p.label = 1)""",
    """cov AS (SELECT p.task, count(*) AS n_pos, count(h.id) AS n_covered FROM r p
            LEFT JOIN hits h ON h.task = p.task AND h.id = p.id WHERE p.label = 1 GROUP BY p.task)""",
)


@query(
    "alerts_per_task",
    _BY_TASK
    + """SELECT t.task, t.n_neg, t.n_pos, coalesce(s.n_alerts, 0) AS n_alerts, round(c.n_covered / c.n_pos, 6) AS coverage,
       round(s.mean_ppv, 6) AS mean_ppv
FROM (SELECT task, CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
             CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos FROM r GROUP BY task) t
LEFT JOIN (SELECT task, CAST(sum(CASE WHEN ppv > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_alerts, avg(ppv) AS mean_ppv
           FROM scored GROUP BY task) s ON s.task = t.task
LEFT JOIN cov c ON c.task = t.task""",
)
def q_alerts_per_task(spark, sf):
    out = A.alerts_per_task(_rows_by_task(spark, sf), docs=_docs(spark, sf))
    return out.select(
        "task", "n_neg", "n_pos", "n_alerts", F.round("coverage", 6).alias("coverage"), F.round("mean_ppv", 6).alias("mean_ppv")
    )


@query("alerts_union", _BY_TASK + "SELECT token, count(*) AS n_tasks FROM alerts GROUP BY token")
def q_alerts_union(spark, sf):
    """The distinct alerts of all tasks."""
    scored, _ = A.alert_ppv(_rows_by_task(spark, sf), group=("task",), docs=_docs(spark, sf))
    return scored.where(F.col("ppv") > 0.5).groupBy("token").agg(F.count(F.lit(1)).alias("n_tasks"))


@query(
    "coverage_pct",
    _BY_TASK + "SELECT task, n_pos, n_covered, round(100.0 * n_covered / n_pos, 6) AS coverage_pct FROM cov",
)
def q_coverage_pct(spark, sf):
    rows = _rows_by_task(spark, sf)
    scored, _ = A.alert_ppv(rows, group=("task",), docs=_docs(spark, sf))
    cov = A.coverage(scored.where(F.col("ppv") > 0.5), _docs(spark, sf), rows, ("task",))
    return cov.select(
        "task",
        F.col("n_pos").cast("bigint").alias("n_pos"),
        F.col("n_covered").cast("bigint").alias("n_covered"),
        F.round(F.lit(100.0) * F.col("coverage"), 6).alias("coverage_pct"),
    )
