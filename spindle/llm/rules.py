"""Operator 8, host-level quality rules, in DataFrame functions only.

Every document is measured and tested against the ``RULES``.  Failures are
summed by host (here the document's source), and a host's failure rate of a
rule is shrunk towards all hosts by an empirical beta prior.  Its mean and
strength are fitted to the hosts' counts as beta-binomial by the method of
moments, in two steps of weights: first a host weighs its documents, then what
its rate is worth at the correlation found, so that neither a huge host nor a
long tail of tiny ones sets the prior.  What chance alone spreads the rates of
small hosts is subtracted; where nothing more is left, or all hosts hold one
document, the prior is as strong as it may be.  Its strength is at least ten
documents, so a document or two alone condemn no host while all hosts' mean
rate is small.  A host whose shrunk rate of a rule exceeds the
rule's limit gets a verdict against it, which is joined back: its documents
that fail that rule go.  Documents that fail a base rule go in any case; a
document that fails nothing stays, whatever its host.

Measuring is one pass without a shuffle: repeated word windows are found
within the row, by sorting one 64-bit value a window (hash in the upper bits,
place in the lower ones), so that equal windows are neighbours; neighbours are
compared word by word.  The measures are written to the checkpoint folder
before they are summed, so texts are read once.  Sums are combined before the
shuffle; a host with a third of all rows is one row per task then, and the
join sees one row per host.

Defined results
* null text: no words, so the base rules fail; empty text likewise
* null host: a host of its own; null doc_id: kept as null
* repeated rows: each counts and gets its verdict; empty table: no rows
* very long texts: n log n in the words of a row; other columns are ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.util import cut_lineage
from .common import BLANK, WORD, read_table, row_key, split_words

SYMBOLS = "[#*$%&|<>]"
#: Rules by name: (condition that fails a document, largest shrunk failure rate of a host).
RULES: dict[str, tuple[str, float]] = {
    "short": ("n_words < 50", 0.5),
    "repeats": ("100 * n_repeat_words > 50 * n_words", 0.5),
    "symbols": ("10 * n_symbols > word_chars", 0.3),
    "dup_lines": ("100 * n_dup_lines > 30 * n_lines", 0.3),
    "long_words": ("word_chars > 15 * n_words", 0.3),
}
#: Rules that fail a document whatever its host.
BASE = ("short", "repeats")
#: Bounds of the prior's strength, in documents.
STRENGTH = (10.0, 1000.0)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words to every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_words", split_words(text, f"[{BLANK}]+"))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    n = F.size("_words")
    # Bits for a window's place: 16, or as many as the text's length needs.
    df = df.withColumn("_bits", F.greatest(F.lit(16), F.ceil(F.log2(n + F.lit(2.0))).cast("int")))

    def window(i: Column) -> Column:
        w = F.col("_words")
        return F.call_function("shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), F.col("_bits")).bitwiseOR(i.cast("bigint"))

    keys = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_keys", keys)

    def place(key: Column) -> Column:
        return key.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bits")) - 1).cast("int")

    def same(a: Column, b: Column) -> Column:
        """Equal windows: by hash, then by their words."""
        w, p, q = F.col("_words"), place(a), place(b)
        by_hash = F.call_function("shiftright", a, F.col("_bits")) == F.call_function("shiftright", b, F.col("_bits"))
        return F.when(by_hash, (w[p] == w[q]) & (w[p + 1] == w[q + 1]) & (w[p + 2] == w[q + 2])).otherwise(False)

    def repeated(key: Column, i: Column) -> Column:
        before = F.when(i > 0, same(key, F.get("_keys", i - 1))).otherwise(False)
        return F.when(before, True).when(i < F.size("_keys") - 1, same(key, F.get("_keys", i + 1))).otherwise(False)

    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_keys", repeated), place)))
    # Words under the windows found: three each, less what two windows share.
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("_at", i - 1)))),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    return df.select(
        *docs.columns,
        n.cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def _moment_sums(weight: Column, rate: Column, n: Column, name: str) -> list[Column]:
    """Sums of a weighted moment fit: of w, w r, w r^2, w / n, w^2 and w^2 / n."""
    terms = {"w": weight, "wr": weight * rate, "wrr": weight * rate * rate, "wn": weight / n, "ww": weight * weight, "wwn": weight * weight / n}
    return [F.sum(c).alias(f"{name}_{k}") for k, c in terms.items()]


def _moment_fit(sums, name: str) -> tuple[float, float]:
    """(mean, correlation) of a beta-binomial; the correlation within what ``STRENGTH`` allows.

    A rate's variance is m (1 - m) (1/n + rho (1 - 1/n)); rho equates the
    weighted squares around the mean with their expectation.
    """
    w, wr, wrr, wn, ww, wwn = (sums[f"{name}_{k}"] or 0.0 for k in ("w", "wr", "wrr", "wn", "ww", "wwn"))
    low, high = 1 / (STRENGTH[1] + 1), 1 / (STRENGTH[0] + 1)
    mean = wr / w if w else 0.0
    chance, room = (wn - wwn / w, (w - wn) - (ww - wwn) / w) if w else (0.0, 0.0)
    if mean <= 0 or mean >= 1 or room <= 1e-9:
        return mean, low
    rho = ((wrr - mean * mean * w) / (mean * (1 - mean)) - chance) / room
    return mean, min(max(rho, low), high)


def host_verdicts(rated: DataFrame) -> DataFrame:
    """(host, n_docs, <rule>_rate, <rule>_bad): shrunk failure rates and verdicts, from rows with host and fails_<rule>."""
    sums = [F.sum(F.col(f"fails_{r}").cast("bigint")).alias(r) for r in RULES]
    hosts = rated.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *sums)
    n = F.col("n_docs").cast("double")

    def fits(weights: dict[str, Column]) -> dict[str, tuple[float, float]]:
        row = hosts.agg(*[c for r in RULES for c in _moment_sums(weights[r], F.col(r) / n, n, r)]).first()
        return {r: _moment_fit(row, r) for r in RULES}

    first = fits(dict.fromkeys(RULES, n))
    fitted = fits({r: n / (F.lit(1.0) + F.lit(first[r][1]) * (n - 1)) for r in RULES})
    out = [F.col("host"), F.col("n_docs")]
    for r, (_, limit) in RULES.items():
        mean, rho = fitted[r]
        strength = 1 / rho - 1
        shrunk = (F.col(r) + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
        out += [shrunk.alias(f"{r}_rate"), (shrunk > limit).alias(f"{r}_bad")]
    return hosts.select(*out)


def quality_rules(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """One row per document: _k (see ``row_key``), doc_id, host, the measures, base_failed, host_failed (rules, comma-joined), kept."""
    rows = row_key(docs.select("doc_id", "text", F.col(host_col).cast("string").alias("host")))
    m = measured(rows).drop("text").withColumns({f"fails_{r}": F.expr(cond) for r, (cond, _) in RULES.items()})
    # A null host gets a value that no other host can have.
    m = m.withColumn("host", F.when(F.col("host").isNull(), "-").otherwise(F.concat(F.lit("="), "host")))
    m = cut_lineage(m)
    bad = host_verdicts(m).select("host", *[f"{r}_bad" for r in RULES])
    joined = m.join(bad, "host", "left")
    against = F.concat_ws(",", *[F.when(F.col(f"fails_{r}") & F.col(f"{r}_bad"), r) for r in RULES])
    base = F.greatest(*[F.col(f"fails_{r}") for r in BASE])
    return joined.select(
        "_k",
        "doc_id",
        F.when(F.col("host") != "-", F.substring("host", 2, 1 << 30)).alias("host"),
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        against.alias("host_failed"),
        (~base & (against == "")).alias("kept"),
    )


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents, with the source as host."""
    return quality_rules(read_table(spark, sf_dir, "documents")).drop("_k", "host", "n_lines")


def _op8_sql() -> str:
    rules = ", ".join(f"({cond}) AS fails_{r}" for r, (cond, _) in RULES.items())
    sums = ", ".join(f"sum(CAST(fails_{r} AS BIGINT)) AS {r}" for r in RULES)
    low, high = f"{1 / (STRENGTH[1] + 1)!r}e0", f"{1 / (STRENGTH[0] + 1)!r}e0"

    def moments(weight) -> str:
        """The sums of a step, from h; ``weight(rule)`` is a host's weight."""
        parts = []
        for r in RULES:
            w, x = weight(r), f"({r} / n_docs)"
            terms = {"w": w, "wr": f"{w} * {x}", "wrr": f"{w} * {x} * {x}", "wn": f"{w} / n_docs", "ww": f"{w} * {w}", "wwn": f"{w} * {w} / n_docs"}
            parts += [f"sum({e}) AS {r}_{k}" for k, e in terms.items()]
        return ", ".join(parts)

    def fit() -> str:
        parts = []
        for r in RULES:
            w, m = f"{r}_w", f"({r}_wr / {r}_w)"
            room = f"({w} - {r}_wn - ({r}_ww - {r}_wwn) / {w})"
            rho = f"(({r}_wrr - {m} * {m} * {w}) / ({m} * (1 - {m})) - ({r}_wn - {r}_wwn / {w})) / {room}"
            parts.append(f"{m} AS {r}_mean, CASE WHEN {m} <= 0 OR {m} >= 1 OR {room} <= 1e-9 THEN {low} ELSE least(greatest({rho}, {low}), {high}) END AS {r}_rho")
        return ", ".join(parts)

    first, second = moments(lambda r: "CAST(n_docs AS DOUBLE)"), moments(lambda r: f"(n_docs / (1e0 + {r}_rho * (n_docs - 1)))")
    strengths = ", ".join(f"{r}_mean, 1 / {r}_rho - 1 AS {r}_s" for r in RULES)
    bad = ", ".join(f"({r} + {r}_mean * {r}_s) / (n_docs + {r}_s) > {limit} AS {r}_bad" for r, (_, limit) in RULES.items())
    against = "concat_ws(',', " + ", ".join(f"CASE WHEN fails_{r} AND {r}_bad THEN '{r}' END" for r in RULES) + ")"
    base = "(" + " OR ".join(f"fails_{r}" for r in BASE) + ")"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
c AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY k),
m AS (
  SELECT d.k, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c USING (k)),
f AS (SELECT *, {rules} FROM m),
h AS (SELECT source, count(*) AS n_docs, {sums} FROM f GROUP BY source),
p1 AS (SELECT {fit()} FROM (SELECT {first} FROM h)),
p2 AS (SELECT {fit()} FROM (SELECT {second} FROM h, p1)),
p AS (SELECT {strengths} FROM p2),
v AS (SELECT source, {bad} FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed,
  {against} AS host_failed, NOT {base} AND {against} = '' AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


OP8_SQL = _op8_sql()
