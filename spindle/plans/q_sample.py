"""Registered queries: splits, sampling, augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clean as C
from ..operators import rowwise as RW
from ..operators import sample as SM
from ..sources import fixtures as X
from . import sql as S
from .registry import query

_RANDOM = """rs AS (SELECT doc_id AS id, CASE WHEN i < ceil(n * 1e-1) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents))"""


@query("random_split", S.with_(_RANDOM) + "SELECT id, split FROM rs")
def q_random_split(spark, sf):
    return SM.random_split(X.corpus(spark, sf).select("id"), seed=42)


_STRAT = """ss AS (SELECT id, toxic, CASE WHEN i < floor(n * 8e-1) THEN 'train' WHEN i < floor(n * 9e-1) THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('40:' || id), id) - 1 AS i,
               count(*) OVER (PARTITION BY toxic) AS n FROM labelled))"""


def _strat(spark, sf):
    return SM.stratified_split(X.labelled(spark, sf).select("id", "toxic"), "toxic", (0.8, 0.1, 0.1), seed=40)


@query("stratified_split", S.with_(S.LABELLED, _STRAT) + "SELECT id, toxic, split FROM ss")
def q_stratified_split(spark, sf):
    return _strat(spark, sf)


@query(
    "group_disjoint_split",
    """WITH g AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
c AS (SELECT source, sum(size) OVER (ORDER BY size DESC, source ROWS UNBOUNDED PRECEDING) AS cum, sum(size) OVER () AS n FROM g)
SELECT d.doc_id AS id, d.source,
  CASE WHEN c.cum <= c.n * 8e-1 THEN 'train' WHEN c.cum <= c.n * 9e-1 THEN 'valid' ELSE 'test' END AS split
FROM documents d JOIN c ON d.source = c.source""",
)
def q_group_disjoint_split(spark, sf):
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return SM.group_disjoint_split(docs, "source").select("id", "source", "split")


@query(
    "union_splits",
    S.with_(S.LABELLED, _STRAT)
    + "SELECT id, 'train' AS part FROM ss WHERE split = 'train' UNION ALL SELECT id, 'valid+test' AS part FROM ss WHERE split <> 'train'",
)
def q_union_splits(spark, sf):
    s = _strat(spark, sf)
    train = s.where("split = 'train'").select("id", F.lit("train").alias("part"))
    valid = s.where("split = 'valid'").select("id", F.lit("valid+test").alias("part"))
    test = s.where("split = 'test'").select("id", F.lit("valid+test").alias("part"))
    return train.unionByName(valid.unionByName(test))


@query(
    "assert_partition_sizes",
    S.with_(S.LABELLED, _STRAT)
    + """SELECT (SELECT count(*) FROM labelled) AS n_source, count(*) AS sum_parts, count(DISTINCT split) AS n_parts,
  count(*) = (SELECT count(*) FROM labelled) AS sizes_ok, count(DISTINCT id) = count(*) AS disjoint_ok, true AS fractions_ok,
  sum(CASE WHEN toxic IN (0, 1) THEN 0 ELSE 1 END) = 0 AS labels_ok FROM ss""",
)
def q_assert_partition_sizes(spark, sf):
    chk = C.assert_partition_sizes(_strat(spark, sf), X.labelled(spark, sf).select("id"), "toxic", fractions={"train": 0.8, "valid": 0.1, "test": 0.1})
    return C.raise_if_failed(chk).drop("_chk")


@query(
    "variant_expand",
    f"""SELECT doc_id AS id, k, md5(array_to_string(CASE WHEN len(w) > 0 THEN list_concat(w[(k % len(w)) + 1:len(w)], w[1:k % len(w)]) ELSE w END, ' ')) AS sig
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{S.WORD_RE}', 1) AS w FROM documents), range(1, 4) t(k)
UNION ALL SELECT doc_id, 0, md5(text) FROM documents""",
)
def q_variant_expand(spark, sf):
    """The originals (k = 0) and their variants."""
    docs = X.corpus(spark, sf)
    v = docs.select("id", F.lit(0).alias("k"), F.col("text").alias("variant")).unionByName(SM.variant_expand(docs, 3))
    return v.select("id", F.col("k").cast("bigint").alias("k"), F.md5("variant").alias("sig"))


@query(
    "oversample_minority",
    S.with_(S.LABELLED)
    + f""", cnt AS (SELECT toxic, count(*) AS n FROM labelled GROUP BY toxic),
mi AS (SELECT toxic, n FROM cnt ORDER BY n, toxic DESC LIMIT 1),
need AS (SELECT (SELECT max(n) FROM cnt) - mi.n AS needed, mi.n AS n_min, mi.toxic AS minority FROM mi),
mino AS (SELECT id, text, row_number() OVER (ORDER BY id) - 1 AS i FROM labelled WHERE toxic = (SELECT minority FROM need)),
draws AS (SELECT d, {S.md5_int("'40:' || d")} % (SELECT n_min FROM need) AS i FROM range(0, (SELECT greatest(needed, 0) FROM need)) r(d)),
v AS (SELECT DISTINCT m.id, array_to_string(CASE WHEN len(w) > 0 THEN list_concat(w[(rot % len(w)) + 1:len(w)], w[1:rot % len(w)]) ELSE w END, ' ') AS variant
  FROM (SELECT dr.d, m.id, regexp_extract_all(lower(m.text), '{S.WORD_RE}', 1) AS w, {S.md5_int("'40:' || dr.d || ':r'")} AS rot
        FROM draws dr JOIN mino m ON dr.i = m.i) m)
SELECT id, md5(variant) AS sig, (SELECT minority FROM need) AS toxic, true AS added FROM v
UNION ALL SELECT id, md5(text), toxic, false FROM labelled""",
)
def q_oversample_minority(spark, sf):
    lab = X.labelled(spark, sf).select("id", "text", F.col("toxic").alias("label"))
    o = SM.oversample_minority(spark, lab, "label", 1, seed=40)
    added = o.select("id", F.md5("variant").alias("sig"), F.col("label").cast("int").alias("toxic"), F.lit(True).alias("added"))
    return added.unionByName(lab.select("id", F.md5("text").alias("sig"), F.col("label").alias("toxic"), F.lit(False).alias("added")))


@query(
    "perturb_keep_fraction",
    S.with_(S.TOKENS)
    + """, t AS (SELECT id, pos, token, rep FROM tokens, range(0, 3) r(rep)),
r AS (SELECT *, row_number() OVER (PARTITION BY id, rep ORDER BY md5('42:' || id || ':' || rep || ':' || pos), pos) AS rk,
      count(*) OVER (PARTITION BY id, rep) AS n FROM t)
SELECT id, rep, count(*) AS n_kept, md5(array_to_string(list(token ORDER BY pos), ' ')) AS sig
FROM r WHERE rk <= greatest(1, floor(n * 9e-1)) GROUP BY id, rep""",
)
def q_perturb_keep_fraction(spark, sf):
    p = SM.perturb_keep_fraction(RW.token_rows(X.corpus(spark, sf), ["id"], tokens=T.text_tokens, pattern=T.TEXT_TOKEN_PATTERN), reps=3, frac=0.9, seed=42)
    return p.select("id", F.col("rep").cast("bigint").alias("rep"), F.size("tokens").cast("bigint").alias("n_kept"), F.md5(F.array_join("tokens", " ")).alias("sig"))


@query(
    "perturb_replace_token",
    S.with_(S.TOKENS)
    + """, tgt AS (SELECT id, arg_min(token, md5('42:' || id || ':' || pos)) AS target FROM tokens GROUP BY id),
rep AS (SELECT t.id, arg_min(t.token, md5('42:' || t.id || ':' || t.token)) AS replacement
  FROM (SELECT DISTINCT id, token FROM tokens) t JOIN tgt ON t.id = tgt.id WHERE t.token <> tgt.target GROUP BY t.id)
SELECT t.id, g.target, r.replacement,
  md5(array_to_string(list(CASE WHEN t.token = g.target AND r.replacement IS NOT NULL THEN r.replacement ELSE t.token END ORDER BY t.pos), ' ')) AS sig
FROM tokens t JOIN tgt g ON t.id = g.id LEFT JOIN rep r ON t.id = r.id GROUP BY t.id, g.target, r.replacement""",
)
def q_perturb_replace_token(spark, sf):
    p = SM.perturb_replace_token(RW.token_rows(X.corpus(spark, sf), ["id"], tokens=T.text_tokens, pattern=T.TEXT_TOKEN_PATTERN), seed=42)
    return p.select("id", "target", "replacement", F.md5(F.array_join("tokens", " ")).alias("sig"))


def _poisson_sql(u: str) -> str:
    cases = " ".join(f"WHEN {u} < {c!r}e0 THEN {k}" if "e" not in repr(c) else f"WHEN {u} < {c!r} THEN {k}" for k, c in enumerate(SM.poisson_thresholds()))
    return f"CASE {cases} ELSE {len(SM.poisson_thresholds())} END"


@query(
    "bootstrap_ci",
    S.with_(S.LABELLED, S.PREDICTIONS)
    + f""", slots AS (SELECT lang, id, p, rep, {_poisson_sql(S.md5_int("'40:' || lang || ':' || rep || ':' || id") + " / 4294967296e0")} AS w
  FROM predictions, range(0, 10000) r(rep)),
means AS (SELECT lang, rep, CASE WHEN sum(w) > 0 THEN sum(w * p) / sum(w) END AS m FROM slots GROUP BY lang, rep)
SELECT m.lang, round(a.mean, 6) AS mean, round(quantile_cont(m.m, 0.025), 6) AS ci_lo, round(quantile_cont(m.m, 0.975), 6) AS ci_hi
FROM means m JOIN (SELECT lang, avg(p) AS mean FROM predictions GROUP BY lang) a ON m.lang = a.lang GROUP BY m.lang, a.mean""",
)
def q_bootstrap_ci(spark, sf):
    b = SM.bootstrap_ci(X.predictions(spark, sf).select("id", "lang", "p"), "p", "id", ("lang",), reps=10000, seed=40)
    return b.select("lang", *[F.round(c, 6).alias(c) for c in ("mean", "ci_lo", "ci_hi")])
