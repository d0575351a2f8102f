"""Registered queries: sorts, limits, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import windows as W
from ..sources import fixtures as X
from . import sql as S
from .registry import query


@query("global_sort", "SELECT doc_id AS id, n_chars FROM documents ORDER BY n_chars DESC, doc_id")
def q_global_sort(spark, sf):
    d = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return d.orderBy(F.col("n_chars").desc(), F.col("id"))


@query("head_n", "SELECT doc_id AS id, lang FROM documents ORDER BY doc_id LIMIT 100")
def q_head_n(spark, sf):
    return X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang").orderBy("id").limit(100)


@query(
    "sort_by_list_median",
    S.with_(S.LABELLED, S.PREDICTIONS)
    + "SELECT lang, round(quantile_cont(p, 0.5), 6) AS median_p, count(*) AS n FROM predictions GROUP BY lang ORDER BY median_p DESC, lang",
)
def q_sort_by_list_median(spark, sf):
    p = X.predictions(spark, sf)
    m = W.with_quantiles(p.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), W.quantiles(p, "p", {"median_p": 0.5}, ("lang",)), ("lang",))
    m = m.select("lang", F.round("median_p", 6).alias("median_p"), "n")
    return m.orderBy(F.col("median_p").desc(), "lang")


@query(
    "distinct_union",
    f"""SELECT DISTINCT token FROM (
  SELECT unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1)) AS token FROM documents
  UNION ALL SELECT unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1)) FROM benchmark
  UNION ALL SELECT unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1)) FROM conversations)""",
)
def q_distinct_union(spark, sf):
    parts = [X.table(spark, sf, t).select(F.explode(T.word_tokens("text")).alias("token")) for t in ("documents", "benchmark", "conversations")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query(
    "set_except",
    S.with_(S.LABELLED)
    + f"""SELECT token FROM (SELECT unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1)) AS token FROM labelled WHERE toxic = 1)
EXCEPT SELECT token FROM (SELECT unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1)) AS token FROM labelled WHERE toxic = 0)""",
)
def q_set_except(spark, sf):
    lab = X.labelled(spark, sf)
    pos = lab.where("toxic = 1").select(F.explode(T.word_tokens("text")).alias("token"))
    neg = lab.where("toxic = 0").select(F.explode(T.word_tokens("text")).alias("token"))
    return pos.join(neg, "token", "left_anti").distinct()


@query(
    "set_jaccard",
    f"""WITH pairs AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(a), '{S.WORD_RE}', 1)) AS x,
             list_distinct(regexp_extract_all(lower(b), '{S.WORD_RE}', 1)) AS y FROM pairs WHERE b IS NOT NULL)
SELECT conv_id, turn, len(list_intersect(x, y)) AS n_common, len(list_distinct(list_concat(x, y))) AS n_union,
  round(CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard
FROM s""",
)
def q_set_jaccard(spark, sf):
    p = X.conversation_pairs(spark, sf).select("conv_id", "turn", T.word_tokens("a").alias("x"), T.word_tokens("b").alias("y"))
    inter, union = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    return p.select(
        "conv_id", "turn", inter.cast("bigint").alias("n_common"), union.cast("bigint").alias("n_union"),
        F.round(F.when(union > 0, inter / union), 6).alias("jaccard"),
    )
