"""Registered queries: scalar string / array / math functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.metrics import P_FLOOR
from ..sources import fixtures as X
from . import sql as S
from .registry import query

_P = S.with_(S.LABELLED, S.PREDICTIONS)


@query(
    "fn_split_join",
    "SELECT doc_id AS id, md5(array_to_string(string_split(text, ' '), ',')) AS comma_sig, md5(array_to_string(string_split(text, ' '), '')) AS glued_sig FROM documents",
)
def q_split_join(spark, sf):
    d = X.corpus(spark, sf).select("id", F.split("text", " ").alias("t"))
    return d.select("id", F.md5(T.join_tokens("t", ",")).alias("comma_sig"), F.md5(T.join_tokens("t", "")).alias("glued_sig"))


@query(
    "fn_strip_prefix",
    """SELECT conv_id, turn, md5(regexp_replace(ltrim(text), '^##', '')) AS stripped_sig,
  md5(regexp_replace(text, '\\s+', '', 'g')) AS nospace_sig FROM conversations""",
)
def q_strip_prefix(spark, sf):
    c = X.table(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn", F.md5(T.strip_continuation("text")).alias("stripped_sig"), F.md5(T.strip_all_whitespace("text")).alias("nospace_sig")
    )


@query(
    "fn_tokens_to_string",
    f"""SELECT conv_id, turn, md5(trim(replace(array_to_string(list_transform(t, lambda x, i: CASE WHEN i > 1 THEN '##' || x ELSE x END), ' '), ' ##', ''))) AS sig
FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '{S.WORD_RE}', 1) AS t FROM conversations)""",
)
def q_tokens_to_string(spark, sf):
    c = X.table(spark, sf, "conversations").select("conv_id", "turn", T.word_tokens("text").alias("t"))
    pieces = F.transform("t", lambda x, i: F.when(i > 0, F.concat(F.lit("##"), x)).otherwise(x))
    return c.select("conv_id", "turn", F.md5(T.tokens_to_string(pieces)).alias("sig"))


@query(
    "fn_contains",
    "SELECT lang, CAST(sum(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) AS BIGINT) AS n_with, count(*) AS n FROM documents GROUP BY lang",
)
def q_contains(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.groupBy("lang").agg(
        F.sum(F.when(F.lower("text").contains("the"), 1).otherwise(0)).cast("bigint").alias("n_with"), F.count(F.lit(1)).alias("n")
    )


@query(
    "fn_parse_list_literal",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(json_extract(('[' || value || ', ' || user_id || ']'), '$[1]') AS DOUBLE) AS second FROM events",
)
def q_parse_list_literal(spark, sf):
    e = X.table(spark, sf, "events")
    lst = T.parse_double_list(F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", "), F.col("user_id").cast("string"), F.lit("]")))
    return e.select("event_id", F.try_element_at(F.from_json("props", "map<string,double>"), F.lit("k")).alias("k"), lst[1].alias("second"))


@query(
    "fn_softmax",
    _P + """SELECT id, round(exp(l0 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))), 3) AS p0,
  round(exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))), 3) AS p1,
  CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS pred FROM predictions""",
)
def q_softmax(spark, sf):
    p = X.predictions(spark, sf)
    p0, p1 = T.softmax2("l0", "l1")
    return p.select("id", F.round(p0, 3).alias("p0"), F.round(p1, 3).alias("p1"), F.when(F.col("l1") > F.col("l0"), 1).otherwise(0).alias("pred"))


@query("fn_logit", _P + "SELECT id, CASE WHEN p > 0 AND p < 1 THEN round(ln(p / (1.0 - p)), 6) END AS logit FROM predictions")
def q_logit(spark, sf):
    """Null where the probability is 0 or 1."""
    p = X.predictions(spark, sf)
    return p.select("id", F.when((F.col("p") > 0) & (F.col("p") < 1), F.round(T.logit("p"), 6)).alias("logit"))


_V = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), "


@query(
    "fn_l2_norm",
    _V
    + """n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
nx AS (SELECT a.vec_id, a.v, a.norm, b.v AS w FROM n a LEFT JOIN n b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(norm, 6) AS norm, list_transform(v, lambda x: CASE WHEN norm > 0 THEN round(x / norm, 6) END) AS unit,
  round(sqrt(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS next_distance FROM nx""",
)
def q_l2_norm(spark, sf):
    """The norm, the whole unit vector (null components for a zero vector), and the distance to the next vector by id."""
    e = X.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    n = T.l2_norm("v")
    gap = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x))
    e = e.join(nxt, "vec_id", "left").withColumn("_n", n)
    unit = F.transform("v", lambda x: F.when(F.col("_n") > 0, F.round(x / F.col("_n"), 6)))
    return e.select("vec_id", F.round("_n", 6).alias("norm"), unit.alias("unit"), F.round(gap, 6).alias("next_distance"))


@query("fn_mean_center", _V + "m AS (SELECT vec_id, v, list_avg(v) AS a FROM e) SELECT vec_id, list_transform(v, lambda x: round(x - a, 5)) AS centred FROM m")
def q_mean_center(spark, sf):
    e = X.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    e = e.withColumn("_mean", mean)
    return e.select("vec_id", F.transform("v", lambda x: F.round(x - F.col("_mean"), 5)).alias("centred"))


@query(
    "fn_binarise",
    _P + "SELECT id, CASE WHEN round(l1) <> 0 THEN 1 ELSE 0 END AS b, CASE WHEN y > 0 THEN 1 ELSE 0 END AS y_bin FROM predictions",
)
def q_binarise(spark, sf):
    p = X.predictions(spark, sf)
    return p.select("id", T.binarise(F.round("l1")).alias("b"), F.when(F.col("y") > 0, 1).otherwise(0).alias("y_bin"))


@query(
    "fn_exp_perplexity",
    _P + """, ll AS (SELECT lang, -ln(CASE WHEN y = 1 THEN greatest(p, 1e-15) ELSE greatest(1.0 - p, 1e-15) END) AS nll FROM predictions)
SELECT lang, round(exp(avg(nll)), 6) AS ppl, round(exp(sum(nll) / count(*)), 6) AS ppl_n, round(exp(avg(nll) * 8 / count(*)), 6) AS ppl_batch
FROM ll GROUP BY lang""",
)
def q_exp_perplexity(spark, sf):
    p = X.predictions(spark, sf)
    nll = -F.log(F.when(F.col("y") == 1, F.greatest("p", F.lit(P_FLOOR))).otherwise(F.greatest(F.lit(1.0) - F.col("p"), F.lit(P_FLOOR))))
    g = p.groupBy("lang").agg(F.avg(nll).alias("loss"), F.sum(nll).alias("tot"), F.count(F.lit(1)).alias("n"))
    return g.select(
        "lang",
        F.round(T.perplexity("loss"), 6).alias("ppl"),
        F.round(T.perplexity("tot", n="n"), 6).alias("ppl_n"),
        F.round(T.perplexity("loss", n="n", batch=F.lit(8)), 6).alias("ppl_batch"),
    )
