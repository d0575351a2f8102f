"""Registered queries: tokenizers, vocabularies, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import encode as E
from ..operators import vocab as V
from ..sources import fixtures as X
from . import sql as S
from .registry import query

SPECIALS_SQL = "specials(token, id) AS (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(V.SPECIALS)) + ")"
_WC = "wc AS (SELECT token, count(*) AS n FROM words GROUP BY token)"
VOCAB500 = (
    "vocab AS (SELECT token, CAST(14 + rn AS INTEGER) AS id FROM "
    "(SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rn FROM wc) WHERE rn <= 500)"
)


def _words(spark, sf):
    return X.tokens(X.corpus(spark, sf), words_only=True)


def _vocab500(spark, sf):
    return V.top_k_vocab(_words(spark, sf), 500)


def _sig(arr):
    return F.md5(F.array_join(arr, " "))


def _ids_str(arr):
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), " ")


def _sum(arr):
    return F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, x: a + x)


# --- tokenizers -----------------------------------------------------------------------------------

@query(
    "tokenize_atomwise",
    f"""SELECT doc_id AS id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS sig
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{S.TEXT_RE}', 1) AS t FROM documents)""",
)
def q_tokenize_atomwise(spark, sf):
    d = X.corpus(spark, sf).select("id", T.text_tokens("text").alias("t"))
    return d.select("id", F.size("t").cast("bigint").alias("n_tokens"), _sig("t").alias("sig"))


_SMILES_RE = T.SMILES_TOKEN_PATTERN.replace("'", "''")


@query(
    "tokenize_smiles",
    f"""SELECT doc_id AS id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS sig
FROM (SELECT doc_id, regexp_extract_all(text, '{_SMILES_RE}', 1) AS t FROM documents)""",
)
def q_tokenize_smiles(spark, sf):
    d = X.corpus(spark, sf).select("id", T.smiles_tokens("text").alias("t"))
    return d.select("id", F.size("t").cast("bigint").alias("n_tokens"), _sig("t").alias("sig"))


@query(
    "tokenize_kmer",
    f"""SELECT doc_id AS id, len(k) AS n_kmers, md5(array_to_string(k, ' ')) AS sig FROM (
  SELECT doc_id, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], '')) AS k
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{S.WORD_RE}', 1) AS w FROM documents))""",
)
def q_tokenize_kmer(spark, sf):
    d = X.corpus(spark, sf).select("id", T.kmer_tokens(T.word_tokens("text"), 3).alias("k"))
    return d.select("id", F.size("k").cast("bigint").alias("n_kmers"), _sig("k").alias("sig"))


@query(
    "tokenize_delimited",
    """SELECT doc_id AS id, len(string_split(text, ' ')) AS n_parts, md5(array_to_string(string_split(text, ' '), ',')) AS sig
FROM documents""",
)
def q_tokenize_delimited(spark, sf):
    d = X.corpus(spark, sf).select("id", F.split("text", " ").alias("t"))
    return d.select("id", F.size("t").cast("bigint").alias("n_parts"), F.md5(T.join_tokens("t", ",")).alias("sig"))


# --- vocabulary lookups ---------------------------------------------------------------------------

@query(
    "unk_rate",
    S.with_(S.WORDS, _WC, VOCAB500)
    + """SELECT d.doc_id AS id, count(w.token) AS n_tokens,
  CAST(sum(CASE WHEN w.token IS NOT NULL AND v.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unk,
  round(CASE WHEN count(w.token) > 0 THEN sum(CASE WHEN w.token IS NOT NULL AND v.id IS NULL THEN 1 ELSE 0 END) / count(w.token) END, 6) AS unk_share,
  (count(w.token) > 0 AND sum(CASE WHEN v.id IS NULL THEN 1 ELSE 0 END) = count(w.token)) AS only_unk
FROM documents d LEFT JOIN words w ON w.id = d.doc_id LEFT JOIN vocab v ON v.token = w.token GROUP BY d.doc_id""",
)
def q_unk_rate(spark, sf):
    docs = X.corpus(spark, sf)
    tok = docs.select("id", F.explode_outer(T.word_tokens("text")).alias("token"))
    r = V.unk_rate(tok, _vocab500(spark, sf), ["id"])
    r = r.withColumn("n_unk", F.when(F.col("n_tokens") == 0, F.lit(0)).otherwise(F.col("n_unk")).cast("bigint"))
    return r.select("id", "n_tokens", "n_unk", F.round("unk_share", 6).alias("unk_share"), "only_unk")


@query(
    "join_vocab_ids",
    S.with_(S.WORDS, _WC, VOCAB500)
    + """SELECT w.id, count(*) AS n_tokens, CAST(sum(coalesce(v.id, 11)) AS BIGINT) AS sum_tid
FROM words w LEFT JOIN vocab v ON v.token = w.token GROUP BY w.id""",
)
def q_join_vocab_ids(spark, sf):
    j = V.lookup_ids(_words(spark, sf), _vocab500(spark, sf))
    return j.groupBy("id").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("tid").cast("bigint").alias("sum_tid"))


# --- vocabulary builders --------------------------------------------------------------------------

@query(
    "vocab_atomwise",
    S.with_(S.TOKENS, SPECIALS_SQL)
    + """SELECT token, CAST(id AS INTEGER) AS id FROM specials
UNION ALL SELECT token, CAST(14 + row_number() OVER (ORDER BY token) AS INTEGER) AS id
FROM (SELECT DISTINCT token FROM tokens WHERE length(trim(token)) > 0 AND token NOT IN (SELECT token FROM specials))""",
)
def q_vocab_atomwise(spark, sf):
    return V.vocab_sorted(spark, X.tokens(X.corpus(spark, sf)))


def _fragments(spark, sf):
    d = X.corpus(spark, sf)
    return d.select("id", F.explode(F.split(F.lower("text"), ",")).alias("token")).select(
        "id", F.trim("token").alias("token")
    ).where(F.length("token") > 0)


@query(
    "vocab_fragments",
    S.with_(SPECIALS_SQL)
    + """, fr AS (SELECT trim(f) AS token FROM (SELECT unnest(string_split(lower(text), ',')) AS f FROM documents) WHERE length(trim(f)) > 0),
c AS (SELECT token, count(*) AS n FROM fr GROUP BY token)
SELECT token, CAST(id AS INTEGER) AS id FROM specials
UNION ALL SELECT token, CAST(14 + row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS id
FROM c WHERE token NOT IN (SELECT token FROM specials)""",
)
def q_vocab_fragments(spark, sf):
    return V.vocab_by_frequency(spark, _fragments(spark, sf))


_WF = f"""wf AS (SELECT token AS word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1)) AS token FROM documents) GROUP BY token)"""
_PAIRS = """pc AS (SELECT substr(word, i, 1) AS "left", substr(word, i + 1, 1) AS "right", CAST(sum(freq) AS BIGINT) AS n
  FROM wf, generate_series(1, length(word) - 1) AS t(i) GROUP BY 1, 2)"""
_TOP_MERGES = """mg AS (SELECT "left", "right" FROM pc ORDER BY n DESC, "left", "right" LIMIT 50)"""
_ATOMS = """atoms AS (SELECT DISTINCT substr(word, i, 1) AS token FROM wf, generate_series(1, length(word)) AS t(i))"""


def _word_freq(spark, sf):
    return _words(spark, sf).groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("freq"))


def _atoms(spark, sf):
    wf = _word_freq(spark, sf)
    return wf.select(F.explode(F.split("word", "")).alias("token")).where(F.length("token") > 0).distinct()


@query(
    "vocab_from_merges",
    S.with_(SPECIALS_SQL, _WF, _PAIRS, _TOP_MERGES, _ATOMS)
    + """, tiers AS (SELECT token, 0 AS tier, lpad(CAST(id AS VARCHAR), 16, '0') AS ord FROM specials
  UNION ALL SELECT token, 1, token FROM atoms
  UNION ALL SELECT "left" || "right", 2, "left" || "right" FROM mg),
firsts AS (SELECT token, min(struct_pack(tier := tier, ord := ord)) AS k FROM tiers WHERE length(trim(token)) > 0 GROUP BY token)
SELECT token, CAST(row_number() OVER (ORDER BY k.tier, k.ord, token) - 1 AS INTEGER) AS id FROM firsts""",
)
def q_vocab_from_merges(spark, sf):
    from ..operators.merges import pair_counts

    merges = pair_counts(_word_freq(spark, sf)).orderBy(F.col("n").desc(), "left", "right").limit(50)
    return V.vocab_from_merges(spark, _atoms(spark, sf), merges)


@query("vocab_from_learned_merges")
def q_vocab_from_learned_merges(spark, sf):
    from ..operators.merges import learn_merges

    merges, _ = learn_merges(spark, _word_freq(spark, sf), 50)
    return V.vocab_from_merges(spark, _atoms(spark, sf), merges)


@query(
    "vocab_from_model",
    S.with_(S.TOKENS, SPECIALS_SQL)
    + """, model AS (SELECT token FROM tokens GROUP BY token HAVING count(*) >= 5)
SELECT token, CAST(id AS INTEGER) AS id FROM specials
UNION ALL SELECT token, CAST(14 + row_number() OVER (ORDER BY token) AS INTEGER) AS id
FROM model WHERE length(trim(token)) > 0 AND token NOT IN (SELECT token FROM specials)""",
)
def q_vocab_from_model(spark, sf):
    tok = X.tokens(X.corpus(spark, sf))
    model = V.token_counts(tok).where(F.col("n") >= 5).select("token")
    return V.vocab_from_model(spark, model)


@query(
    "ordered_union",
    S.with_(SPECIALS_SQL, _WF, _ATOMS)
    + """, tiers AS (SELECT token, 0 AS tier, lpad(CAST(id AS VARCHAR), 16, '0') AS ord FROM specials
  UNION ALL SELECT token, 1, token FROM atoms
  UNION ALL SELECT word, 2, word FROM wf),
firsts AS (SELECT token, min(struct_pack(tier := tier, ord := ord)) AS k FROM tiers WHERE length(trim(token)) > 0 GROUP BY token)
SELECT token, CAST(row_number() OVER (ORDER BY k.tier, k.ord, token) - 1 AS INTEGER) AS id, k.tier AS tier FROM firsts""",
)
def q_ordered_union(spark, sf):
    wf = _word_freq(spark, sf)
    atoms = _atoms(spark, sf)
    v = V.ordered_union(
        spark,
        [atoms.select("token", F.col("token").alias("ord")), wf.select(F.col("word").alias("token"), F.col("word").alias("ord"))],
    )
    tier = F.when(F.col("id") < V.N_SPECIALS, 0).otherwise(F.when(F.length("token") == 1, 1).otherwise(2))
    return v.select("token", "id", tier.alias("tier"))


# --- encoding -------------------------------------------------------------------------------------

_CONV_WORDS = f"""cw AS (SELECT conv_id, turn, generate_subscripts(t, 1) AS pos, unnest(t) AS token
  FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '{S.WORD_RE}', 1) AS t FROM conversations))"""
_ENC = """enc AS (SELECT c.conv_id, c.turn, [12] || coalesce(e.ids, []) || [13] AS ids FROM conversations c
  LEFT JOIN (SELECT conv_id, turn, list(coalesce(v.id, 11) ORDER BY pos) AS ids FROM cw LEFT JOIN vocab v ON v.token = cw.token
             GROUP BY conv_id, turn) e ON e.conv_id = c.conv_id AND e.turn = c.turn)"""


def _encoded_turns(spark, sf):
    conv = X.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return E.encode_ids(conv, _vocab500(spark, sf), ["conv_id", "turn"])


@query(
    "encode_ids",
    S.with_(S.WORDS, _WC, VOCAB500, _CONV_WORDS, _ENC)
    + "SELECT conv_id, turn, len(ids) AS n_ids, CAST(list_sum(ids) AS BIGINT) AS sum_ids, array_to_string(ids, ' ') AS ids FROM enc",
)
def q_encode_ids(spark, sf):
    e = _encoded_turns(spark, sf)
    return e.select(
        "conv_id", "turn", F.size("input_ids").cast("bigint").alias("n_ids"), _sum("input_ids").alias("sum_ids"), _ids_str("input_ids").alias("ids")
    )


_PAIRS_SQL = """pairs AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)"""


def _pair_ids_sql(col):
    return f"""(SELECT p.conv_id, p.turn, list(coalesce(v.id, 11) ORDER BY w.pos) FILTER (WHERE w.token IS NOT NULL) AS ids
  FROM pairs p LEFT JOIN (SELECT conv_id, turn, generate_subscripts(t, 1) AS pos, unnest(t) AS token
     FROM (SELECT conv_id, turn, regexp_extract_all(lower({col}), '{S.WORD_RE}', 1) AS t FROM pairs WHERE b IS NOT NULL)) w
  ON w.conv_id = p.conv_id AND w.turn = p.turn LEFT JOIN vocab v ON v.token = w.token WHERE p.b IS NOT NULL GROUP BY p.conv_id, p.turn)"""


_ENC_PAIR = (
    "ep AS (SELECT a.conv_id, a.turn, [12] || coalesce(a.ids, []) || [13] || coalesce(b.ids, []) || [13] AS ids,"
    " len(coalesce(b.ids, [])) + 1 AS n_type1 FROM "
    + _pair_ids_sql("a") + " a JOIN " + _pair_ids_sql("b") + " b ON a.conv_id = b.conv_id AND a.turn = b.turn)"
)


def _encoded_pairs(spark, sf):
    return E.encode_pair(X.conversation_pairs(spark, sf), _vocab500(spark, sf), ["conv_id", "turn"])


@query(
    "encode_pair",
    S.with_(S.WORDS, _WC, VOCAB500, _PAIRS_SQL, _ENC_PAIR)
    + "SELECT conv_id, turn, len(ids) AS n_ids, CAST(list_sum(ids) AS BIGINT) AS sum_ids, n_type1 FROM ep",
)
def q_encode_pair(spark, sf):
    e = _encoded_pairs(spark, sf)
    return e.select(
        "conv_id", "turn", F.size("input_ids").cast("bigint").alias("n_ids"), _sum("input_ids").alias("sum_ids"),
        _sum("token_type_ids").alias("n_type1"),
    )


@query(
    "special_tokens_mask",
    S.with_(S.WORDS, _WC, VOCAB500, _PAIRS_SQL, _ENC_PAIR)
    + """SELECT conv_id, turn, CAST(list_sum(list_transform(ids, lambda x: CASE WHEN x IN (12, 13) THEN 1 ELSE 0 END)) AS BIGINT) AS n_special,
  array_to_string(list_transform(ids, lambda x: CASE WHEN x IN (12, 13) THEN 1 ELSE 0 END), '') AS mask FROM ep""",
)
def q_special_tokens_mask(spark, sf):
    e = _encoded_pairs(spark, sf).select("conv_id", "turn", E.special_tokens_mask(F.col("input_ids")).alias("m"))
    return e.select("conv_id", "turn", _sum("m").alias("n_special"), F.array_join(F.transform("m", lambda x: x.cast("string")), "").alias("mask"))


_DOC_ENC = """denc AS (SELECT d.doc_id AS id, coalesce(e.ids, []) AS ids FROM documents d LEFT JOIN
  (SELECT w.id, list(coalesce(v.id, 11) ORDER BY w.pos) AS ids FROM words w LEFT JOIN vocab v ON v.token = w.token GROUP BY w.id) e
  ON e.id = d.doc_id)"""


def _encoded_docs(spark, sf):
    return E.encode_ids(X.corpus(spark, sf), _vocab500(spark, sf), ["id"])


@query(
    "truncate_pad",
    S.with_(S.WORDS, _WC, VOCAB500, _DOC_ENC)
    + """SELECT id, 128 AS seq_len, least(len(ids), 126) + 2 AS n_real,
  CAST(25 + coalesce(list_sum(ids[1:126]), 0) AS BIGINT) AS sum_ids FROM denc""",
)
def q_truncate_pad(spark, sf):
    e = _encoded_docs(spark, sf)
    padded, mask = E.truncate_pad(F.col("input_ids"), 128)
    e = e.select("id", padded.alias("ids"), mask.alias("mask"))
    return e.select("id", F.size("ids").alias("seq_len"), _sum("mask").alias("n_real"), _sum("ids").alias("sum_ids"))


@query(
    "decode_ids",
    S.with_(S.WORDS, _WC, VOCAB500, _CONV_WORDS)
    + """SELECT c.conv_id, c.turn, md5(coalesce(array_to_string(e.toks, ' '), '')) AS sig FROM conversations c LEFT JOIN
  (SELECT conv_id, turn, list(cw.token ORDER BY pos) FILTER (WHERE v.id IS NOT NULL) AS toks
   FROM cw LEFT JOIN vocab v ON v.token = cw.token GROUP BY conv_id, turn) e ON e.conv_id = c.conv_id AND e.turn = c.turn""",
)
def q_decode_ids(spark, sf):
    enc = _encoded_turns(spark, sf)
    vocab = _vocab500(spark, sf).unionByName(V.specials(spark))
    dec = E.decode_ids(enc, vocab, ["conv_id", "turn"])
    return dec.select("conv_id", "turn", F.md5(F.array_join("tokens", " ")).alias("sig"))


@query(
    "mlm_mask",
    S.with_(S.WORDS, _WC, VOCAB500, _DOC_ENC)
    + f""", pos AS (SELECT id, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS x FROM (SELECT id, [12] || ids || [13] AS s FROM denc)),
u AS (SELECT id, i, x, x NOT IN (12, 13, 0) AND {S.md5_int("'42:' || id || ':' || i")} / 4294967296.0 < 0.15 AS sel,
        {S.md5_int("'42:' || id || ':' || i || ':m'")} / 4294967296.0 < 0.8 AS msk FROM pos)
SELECT id, CAST(sum(CASE WHEN sel THEN 1 ELSE 0 END) AS BIGINT) AS n_selected,
  CAST(sum(CASE WHEN sel AND msk THEN 1 ELSE 0 END) AS BIGINT) AS n_masked,
  CAST(sum(CASE WHEN sel THEN x ELSE 0 END) AS BIGINT) AS sum_labels,
  CAST(sum(CASE WHEN sel AND msk THEN 14 ELSE x END) AS BIGINT) AS sum_input FROM u GROUP BY id""",
)
def q_mlm_mask(spark, sf):
    m = E.mlm_mask(_encoded_docs(spark, sf), "id")
    return m.select(
        "id",
        F.size(F.filter("mlm_labels", lambda x: x != -100)).cast("bigint").alias("n_selected"),
        F.size(F.filter(F.arrays_zip("masked_ids", "input_ids"), lambda s: (s["masked_ids"] == 14) & (s["input_ids"] != 14))).cast("bigint").alias("n_masked"),
        F.aggregate(F.filter("mlm_labels", lambda x: x != -100), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_labels"),
        _sum("masked_ids").alias("sum_input"),
    )


@query(
    "mask_each_position",
    S.with_(S.WORDS, _WC, VOCAB500, _CONV_WORDS, _ENC)
    + """, ex AS (SELECT conv_id, turn, generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS target_id, list_sum(ids) AS s FROM enc)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, target_id, CAST(s - target_id + 14 AS BIGINT) AS masked_sum FROM ex WHERE target_id NOT IN (12, 13, 0)""",
)
def q_mask_each_position(spark, sf):
    m = E.mask_each_position(_encoded_turns(spark, sf), ["conv_id", "turn"])
    return m.select("conv_id", "turn", "pos", "target_id", "masked_sum")


# --- profiles and dictionaries --------------------------------------------------------------------

def _profile_sql():
    toks = {
        "word": f"unnest(regexp_extract_all(lower(text), '{S.WORD_RE}', 1))",
        "char": "unnest(regexp_extract_all(lower(text), '(\\S)', 1))",
        "word3": "unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], '')))",
    }
    src = f"(SELECT text, regexp_extract_all(lower(text), '{S.WORD_RE}', 1) AS w FROM documents)"
    parts = []
    for name, expr in toks.items():
        for k in (100, 1000):
            parts.append(
                f"""SELECT '{name}' AS tokenizer, {k} AS vocab_size, (SELECT count(*) FROM documents) AS rows, count(*) AS tokens,
  round(avg(CASE WHEN v.token IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unk_share,
  round(count(*) / (SELECT count(*) FROM documents), 6) AS tokens_per_row
FROM (SELECT {expr} AS token FROM {src}) t LEFT JOIN (
  SELECT token FROM (SELECT token, count(*) AS n FROM (SELECT {expr} AS token FROM {src}) GROUP BY token)
  ORDER BY n DESC, token LIMIT {k}) v ON v.token = t.token"""
            )
    return "\nUNION ALL\n".join(parts)


@query("tokenizer_profile", _profile_sql())
def q_tokenizer_profile(spark, sf):
    p = V.tokenizer_profile(X.corpus(spark, sf), [100, 1000])
    return p.select(
        "tokenizer", "vocab_size", "rows", "tokens", F.round("unk_share", 6).alias("unk_share"),
        F.round("tokens_per_row", 6).alias("tokens_per_row"),
    )


_ALT = "(" + "|".join(p for _, p in V.PATTERN_DICTIONARY) + ")"
_GRP = "CASE " + " ".join(f"WHEN regexp_full_match(m, '{p}') THEN '{n}'" for n, p in V.PATTERN_DICTIONARY) + " END"


@query(
    "dictionary_group_counts",
    f"""SELECT id, grp, count(*) AS n FROM (SELECT id, {_GRP} AS grp FROM
  (SELECT doc_id AS id, unnest(regexp_extract_all(text, '{_ALT}', 1)) AS m FROM documents)) GROUP BY id, grp""",
)
def q_dictionary_group_counts(spark, sf):
    return V.dictionary_group_counts(X.corpus(spark, sf))


@query(
    "dictionary_coverage",
    f"""SELECT id, matched, total, round(CASE WHEN total > 0 THEN matched / total ELSE 1.0 END, 6) AS coverage, matched = total AS success
FROM (SELECT doc_id AS id, length(array_to_string(regexp_extract_all(text, '{_ALT}', 1), '')) AS matched,
  length(regexp_replace(text, '\\s', '', 'g')) AS total FROM documents)""",
)
def q_dictionary_coverage(spark, sf):
    c = V.dictionary_coverage(X.corpus(spark, sf))
    return c.select("id", "matched", "total", F.round("coverage", 6).alias("coverage"), "success")
