"""Shared DuckDB SQL fragments for the oracle queries.

They spell out the fixed fixture definitions (SURVEY §7.4) in DuckDB's
dialect: same regexes, same md5 keys, same rounding.
"""

TEXT_RE = r"(\p{L}+|[0-9]+|[^\p{L}0-9\s])"
WORD_RE = r"(\p{L}+)"

LABELLED = """labelled AS (
  SELECT d.doc_id AS id, d.text, d.source, d.lang, l.toxic, l.quality
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

TOKENS = f"""tokens AS (
  SELECT id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
  FROM (SELECT doc_id AS id, regexp_extract_all(lower(text), '{TEXT_RE}', 1) AS t FROM documents))"""

WORDS = f"""words AS (
  SELECT id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
  FROM (SELECT doc_id AS id, regexp_extract_all(lower(text), '{WORD_RE}', 1) AS t FROM documents))"""


def vowel_share(col: str = "text") -> str:
    return (
        f"CASE WHEN length({col}) > 0 THEN round((length({col}) - length(regexp_replace(lower({col}), '[aeiou]', '', 'g')))"
        f" / length({col}), 4) ELSE 0.0 END"
    )


def space_share(col: str = "text") -> str:
    return (
        f"CASE WHEN length({col}) > 0 THEN round((length({col}) - length(replace({col}, ' ', '')))"
        f" / length({col}), 4) ELSE 0.0 END"
    )


PREDICTIONS = f"""predictions AS (
  SELECT id, toxic AS y, 0.0 AS l0, 40.0 * (p - 0.35) AS l1, p, p2, source, lang, quality
  FROM (SELECT id, toxic, quality, source, lang, {vowel_share()} AS p, {space_share()} AS p2 FROM labelled))"""


def md5_int(expr: str) -> str:
    """First 32 bits of md5(expr) as bigint (Spark: conv(substr(md5, 1, 8), 16, 10))."""
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


EXPERIMENTS = """experiments AS (SELECT 'toxic' AS task, tokenizer_type, mol_rep, vocab_size, n, score,
    score - 1.96e0 * sqrt(score * (1.0 - score) / n) AS score_lb, score + 1.96e0 * sqrt(score * (1.0 - score) / n) AS score_ub, perplexity
  FROM (SELECT lang AS tokenizer_type, (CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) + 1) * 100 AS vocab_size,
          CASE WHEN quality = 1 THEN 'smiles' ELSE 'selfies' END AS mol_rep, count(*) AS n,
          avg(CASE WHEN (l1 > l0) = (y = 1) THEN 1.0 ELSE 0.0 END) AS score,
          exp(avg(-ln(greatest(CASE WHEN y = 1 THEN 1.0 / (1.0 + exp(l0 - l1)) ELSE 1.0 - 1.0 / (1.0 + exp(l0 - l1)) END, 1e-15)))) AS perplexity
        FROM predictions GROUP BY 1, 2, 3))"""
