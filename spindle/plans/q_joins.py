"""Registered queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window


from ..operators import alerts as A
from ..operators import joins as J
from ..operators import vectors as V
from ..sources import fixtures as X
from . import sql as S
from .q_alerts import _POS_CAND, _rows
from .registry import query


def _docs(spark, sf):
    return X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")


def _labels(spark, sf):
    return X.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "toxic")


@query(
    "join_fragments_by_id",
    "SELECT d.doc_id AS id, d.lang, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def q_join_fragments_by_id(spark, sf):
    inner, _ = J.join_by_id(_docs(spark, sf).select("id", "lang"), _labels(spark, sf))
    return inner


@query(
    "join_fragments_rejects",
    "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def q_join_fragments_rejects(spark, sf):
    _, rejects = J.join_by_id(_docs(spark, sf).select("id"), _labels(spark, sf))
    return rejects


@query(
    "join_best_rows",
    """SELECT m.lang, m.n_chars, d.doc_id AS id FROM (SELECT lang, max(n_chars) AS n_chars FROM documents GROUP BY lang) m
LEFT JOIN documents d ON d.lang = m.lang AND d.n_chars = m.n_chars""",
)
def q_join_best_rows(spark, sf):
    d = _docs(spark, sf)
    best = d.groupBy("lang").agg(F.max("n_chars").alias("n_chars"))
    return best.join(d, ["lang", "n_chars"], "left").select("lang", "n_chars", "id")


_SETS = S.with_(S.WORDS) + """, sets AS (SELECT DISTINCT id, token FROM words),
per AS (SELECT id, list(token ORDER BY token) AS tokens FROM sets GROUP BY id),
grp AS (SELECT tokens, min(id) AS id, count(*) AS m FROM per GROUP BY tokens),
rs AS (SELECT s.id, s.token FROM sets s JOIN grp g ON s.id = g.id),
sz AS (SELECT id, count(*) AS n FROM rs GROUP BY id)
"""


def _sets(spark, sf):
    return X.corpus(spark, sf).select("id", X.T.word_tokens("text").alias("tokens"))


@query(
    "similarity_self_join",
    _SETS
    + """, inter AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM rs a JOIN rs b ON a.token = b.token AND a.id < b.id GROUP BY 1, 2)
SELECT i.id_a, i.id_b, i.c AS n_common, sa.n + sb.n - i.c AS n_union, round(i.c / (sa.n + sb.n - i.c), 6) AS jaccard
FROM inter i JOIN sz sa ON sa.id = i.id_a JOIN sz sb ON sb.id = i.id_b WHERE i.c * 5 > 3 * (sa.n + sb.n - i.c)""",
)
def q_similarity_self_join(spark, sf):
    pairs, _ = J.similarity_self_join(_sets(spark, sf), 0.6)
    return pairs.select(
        "id_a", "id_b", F.col("n_common").cast("bigint").alias("n_common"), F.col("n_union").cast("bigint").alias("n_union"),
        F.round("jaccard", 6).alias("jaccard"),
    )


@query("similarity_copies", _SETS + "SELECT id, m FROM grp WHERE m >= 2")
def q_similarity_copies(spark, sf):
    _, copies = J.similarity_self_join(_sets(spark, sf), 0.6, copies_only=True)
    return copies.where(F.col("m") >= 2)


@query("similarity_members", _SETS + "SELECT p.id, g.id AS rep FROM per p JOIN grp g ON p.tokens = g.tokens")
def q_similarity_members(spark, sf):
    return J.similarity_members(_sets(spark, sf))


@query(
    "cosine_pairs",
    """WITH f AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS n FROM f
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
g AS (SELECT u, min(id) AS id, count(*) AS m FROM (SELECT id, list_transform(v, lambda x: x / n) AS u FROM n WHERE n > 0 AND isfinite(n)) GROUP BY u)
SELECT a.id AS id_a, b.id AS id_b, round(least(list_dot_product(a.u, b.u), 1e0), 6) AS cosine, a.m AS m_a, b.m AS m_b
FROM g a JOIN g b ON a.id < b.id WHERE list_dot_product(a.u, b.u) >= 4e-1""",
)
def q_cosine_pairs(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    # the driver embeddings are spread out (max cosine about 0.5), hence the low threshold
    return V.cosine_pairs(e, 0.4).withColumn("cosine", F.round("cosine", 6))


_ROLE_RANK = """r AS (SELECT conv_id, role, length(text) AS len, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rank FROM conversations),
u AS (SELECT conv_id, rank, len AS a FROM r WHERE role = 'user'),
s AS (SELECT conv_id, rank, len AS b FROM r WHERE role = 'assistant')"""


def _role(spark, sf, role, out):
    c = X.table(spark, sf, "conversations").where(F.col("role") == role)
    return c.select("conv_id", "turn", F.length("text").alias(out))


@query("zip_rank_join", S.with_(_ROLE_RANK) + "SELECT u.conv_id, u.rank, u.a, s.b FROM u JOIN s ON u.conv_id = s.conv_id AND u.rank = s.rank")
def q_zip_rank_join(spark, sf):
    z = J.zip_rank_join(_role(spark, sf, "user", "la"), _role(spark, sf, "assistant", "lb"), ["conv_id"], "la", "lb", "turn", "turn")
    return z.select("conv_id", F.col("rank").cast("bigint").alias("rank"), "a", "b")


@query(
    "pad_rank_join",
    S.with_(_ROLE_RANK)
    + """SELECT coalesce(u.conv_id, s.conv_id) AS conv_id, coalesce(u.rank, s.rank) AS rank, CAST(coalesce(u.a, 0) AS DOUBLE) AS a,
  CAST(coalesce(s.b, 0) AS DOUBLE) AS b FROM u FULL OUTER JOIN s ON u.conv_id = s.conv_id AND u.rank = s.rank""",
)
def q_pad_rank_join(spark, sf):
    ua = _role(spark, sf, "user", "la")
    ub = _role(spark, sf, "assistant", "lb")
    ra = ua.select("conv_id", F.col("la").cast("double").alias("a"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"))
    rb = ub.select("conv_id", F.col("lb").cast("double").alias("b"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"))
    p = J.pad_rank_join(ra, rb, ["conv_id"])
    return p.select("conv_id", F.col("rank").cast("bigint").alias("rank"), "a", "b")


@query(
    "alerts_semi_join",
    _POS_CAND
    + f""", alerts AS (SELECT token FROM scored WHERE ppv > 0.5)
SELECT id, count(DISTINCT token) AS n_alert_tokens FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1)) AS token FROM documents)
WHERE token IN (SELECT token FROM alerts) GROUP BY id""",
)
def q_alerts_semi_join(spark, sf):
    alerts = A.structural_alerts(_rows(spark, sf)).select("token")
    tok = X.tokens(X.corpus(spark, sf), words_only=True)
    hit = tok.join(alerts, "token", "left_semi")
    return hit.groupBy("id").agg(F.countDistinct("token").alias("n_alert_tokens"))



