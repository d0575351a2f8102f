"""Vocabularies: build, order, look up.

A vocabulary is a DataFrame ``(token string, id int)``.  Ids of learned
vocabularies are assigned with the range-partitioned ordinal index, never a
single-partition window; lookups broadcast the vocabulary only when its size
is bounded by a parameter (top-k) or checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .util import small_side, written
from .windows import ordinal_index

# ---------------------------------------------------------------------------
# Special tokens and their ids (id = position in this list)
# ---------------------------------------------------------------------------
SPECIALS = [
    "[PAD]",
    "[unused1]", "[unused2]", "[unused3]", "[unused4]", "[unused5]",
    "[unused6]", "[unused7]", "[unused8]", "[unused9]", "[unused10]",
    "[UNK]", "[CLS]", "[SEP]", "[MASK]",
]
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 11, 12, 13, 14
N_SPECIALS = len(SPECIALS)


def specials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(SPECIALS)], "token string, id int")


def token_counts(tok: DataFrame) -> DataFrame:
    """#37: (token, n) over a tokens table."""
    return tok.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def top_k_vocab(tok: DataFrame, k: int, first_id: int = N_SPECIALS) -> DataFrame:
    """The k most frequent tokens by (count desc, token) with ids from ``first_id``.

    A top-k report: the limit is the feature, and k bounds the size, so the
    result may be broadcast.
    """
    top = token_counts(tok).orderBy(F.col("n").desc(), F.col("token")).limit(k)
    return ordinal_index(top, [F.col("n").desc(), F.col("token")], out="_i").select(
        "token", (F.col("_i") + first_id).cast("int").alias("id")
    )


def ordered_union(spark: SparkSession, tiers: list[DataFrame], with_specials: bool = True) -> DataFrame:
    """#66: specials ++ tier 1 ++ tier 2 …, each tier ``(token, ord)``; first occurrence
    wins, blank tokens dropped, ids consecutive from 0."""
    parts = []
    if with_specials:
        parts.append(specials(spark).select("token", F.lit(0).alias("tier"), F.lpad(F.col("id").cast("string"), 16, "0").alias("ord")))
    for i, t in enumerate(tiers, start=1):
        parts.append(t.select("token", F.lit(i).alias("tier"), F.col("ord").cast("string").alias("ord")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.where(F.length(F.trim("token")) > 0)
    first = u.groupBy("token").agg(F.min(F.struct("tier", "ord")).alias("k")).select("token", "k.tier", "k.ord")
    return ordinal_index(first, [F.col("tier"), F.col("ord"), F.col("token")], out="id").select(
        "token", F.col("id").cast("int").alias("id")
    )


def _sorted_tier(df: DataFrame) -> DataFrame:
    """A tier ordered by the token itself (binary string order)."""
    return df.select("token").distinct().select("token", F.col("token").alias("ord"))


def vocab_sorted(spark: SparkSession, tok: DataFrame) -> DataFrame:
    """#92 ``vocab_atomwise``: specials + sorted distinct corpus tokens."""
    return ordered_union(spark, [_sorted_tier(tok)])


def vocab_by_frequency(spark: SparkSession, tok: DataFrame) -> DataFrame:
    """#93 ``vocab_fragments``: specials + distinct fragments by (count desc, token)."""
    c = token_counts(tok)
    # ord as a sortable string: zero-padded inverted count, then the token
    ordk = F.concat(F.lpad((F.lit(10**15) - F.col("n")).cast("string"), 16, "0"), F.lit("\u0000"), F.col("token"))
    return ordered_union(spark, [c.select("token", ordk.alias("ord"))])


def vocab_from_merges(spark: SparkSession, atoms: DataFrame, merges: DataFrame) -> DataFrame:
    """#94: specials + sorted atoms + sorted merged strings (merges ``(left, right)``)."""
    merged = merges.select(F.concat("left", "right").alias("token"))
    return ordered_union(spark, [_sorted_tier(atoms), _sorted_tier(merged)])


def vocab_from_model(spark: SparkSession, model_tokens: DataFrame) -> DataFrame:
    """#95: specials + sorted model vocabulary with blank tokens removed."""
    return ordered_union(spark, [_sorted_tier(model_tokens)])


def scan_vocab(lines: DataFrame, group: tuple = ()) -> DataFrame:
    """#5: vocabulary lines ``(line_no, token)`` → (token, id = line number); a
    duplicated token keeps its last line."""
    return lines.groupBy(*group, "token").agg(F.max("line_no").cast("int").alias("id"))


def vocab_gaps(vocab: DataFrame, group: tuple = ()) -> DataFrame:
    """#10 gap check: ids whose predecessor is missing (not the first id)."""
    if not group:
        return vocab_gaps(vocab.withColumn("_all", F.lit(0)), ("_all",)).drop("_all")
    g = list(group)
    prev = vocab.select(*g, (F.col("id") + 1).alias("id"), F.lit(1).alias("_has_prev"))
    first = vocab.groupBy(*g).agg(F.min("id").alias("_min"))
    j = vocab.join(prev, [*g, "id"], "left").join(first, g)
    return j.where(F.col("_has_prev").isNull() & (F.col("id") != F.col("_min"))).select(*g, "token", "id")


def lookup_ids(tok: DataFrame, vocab: DataFrame, unk_id: int = UNK_ID, out: str = "tid") -> DataFrame:
    """#28: token → id, unknown tokens get the [UNK] id.

    The vocabulary is broadcast if its checked size allows it."""
    v = small_side(vocab.select("token", F.col("id").alias("_vid")))
    return tok.join(v, "token", "left").withColumn(out, F.coalesce(F.col("_vid"), F.lit(unk_id))).drop("_vid")


def unk_rate(tok: DataFrame, vocab: DataFrame, key: list[str]) -> DataFrame:
    """#83: per row: tokens, unknown tokens, share unknown, all-unknown flag."""
    j = lookup_ids(tok, vocab)
    return j.groupBy(*key).agg(
        F.count("token").alias("n_tokens"),
        F.sum(F.when(F.col("tid") == UNK_ID, 1).otherwise(0)).cast("bigint").alias("n_unk"),
    ).select(
        *key,
        "n_tokens",
        "n_unk",
        F.when(F.col("n_tokens") > 0, F.col("n_unk") / F.col("n_tokens")).alias("unk_share"),
        ((F.col("n_unk") == F.col("n_tokens")) & (F.col("n_tokens") > 0)).alias("only_unk"),
    )


# ---------------------------------------------------------------------------
# #104 ordered pattern dictionary (fixed values, priority order)
# ---------------------------------------------------------------------------
PATTERN_DICTIONARY = [
    ("digits", r"[0-9]+"),
    ("capitalised", r"\p{Lu}\p{Ll}*"),
    ("lower", r"\p{Ll}+"),
    ("punct", r"[.,;:!?]"),
]


def dictionary_matches(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """Non-overlapping leftmost matches of the ordered dictionary: (key, pos, grp, match)."""
    alternation = "(" + "|".join(p for _, p in PATTERN_DICTIONARY) + ")"
    m = df.select(key, F.posexplode(T.all_matches(F.col(text), alternation)).alias("pos", "m"))
    grp = None
    for name, pat in PATTERN_DICTIONARY:
        cond = F.col("m").rlike("^(" + pat + ")$")
        grp = F.when(cond, F.lit(name)) if grp is None else grp.when(cond, F.lit(name))
    return m.select(key, "pos", grp.alias("grp"), "m")


def dictionary_group_counts(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """#104: matches per (row, group)."""
    return dictionary_matches(df, text, key).groupBy(key, "grp").agg(F.count(F.lit(1)).alias("n"))


def dictionary_coverage(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """#104: matched characters / non-space characters; success when everything is covered."""
    alternation = "(" + "|".join(p for _, p in PATTERN_DICTIONARY) + ")"
    matched = F.length(F.array_join(T.all_matches(F.col(text), alternation), ""))
    total = F.length(F.regexp_replace(F.col(text), r"\s", ""))
    return df.select(
        key,
        matched.alias("matched"),
        total.alias("total"),
        F.when(total > 0, matched / total).otherwise(F.lit(1.0)).alias("coverage"),
        (matched == total).alias("success"),
    )


def char_tokens(text) -> "F.Column":
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), r"\s", ""), ""), "")


TOKENIZERS = {
    "word": lambda c: T.word_tokens(c),
    "char": lambda c: char_tokens(c),
    "word3": lambda c: T.kmer_tokens(T.word_tokens(c), 3),
}


def tokenizer_profile(df: DataFrame, sizes: list[int], text: str = "text", key: str = "id") -> DataFrame:
    """#103: per (tokenizer, vocab size): rows, tokens, tokens per row, UNK share.

    The vocabulary of each (tokenizer, size) is its top-``size`` tokens.
    Rows without tokens still count as rows (``explode_outer``).
    """
    n_rows = df.agg(F.count_distinct(key)).scalar()
    out = None
    for name, fn in TOKENIZERS.items():
        # One pass over the texts: all sizes share the counts of the distinct tokens.
        counts = written(df.select(F.explode(fn(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), "profile")
        total = counts.agg(F.sum("n")).scalar()
        top = counts.orderBy(F.col("n").desc(), "token").limit(max(sizes))
        ranked = top.withColumn("_r", F.row_number().over(Window.orderBy(F.col("n").desc(), "token")))
        known = ranked.agg(*[F.sum(F.when(F.col("_r") <= k, F.col("n"))).alias(f"k{k}") for k in sizes])
        each = F.inline(F.array(*[F.struct(F.lit(k).alias("vocab_size"), F.col(f"k{k}").alias("_known")) for k in sizes]))
        prof = known.select(F.lit(name).alias("tokenizer"), each).withColumns({"rows": n_rows, "tokens": F.coalesce(total, F.lit(0)), "_total": total})
        out = prof if out is None else out.unionByName(prof)
    out = out.withColumn("unk_share", F.lit(1.0) - F.try_divide(F.col("_known"), F.col("_total")))
    return out.select("tokenizer", "vocab_size", "rows", "tokens", "unk_share").withColumn("tokens_per_row", F.col("tokens") / F.col("rows"))
