"""Joins.

All joins are equi-joins on explicit ids so Catalyst can pick broadcast /
sort-merge and AQE can split skewed keys.  Theta joins are rewritten into
equi-joins (#30).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .matcher import match_tokens, put_together
from .setpairs import candidates, compared
from .util import written

LETTERS_ONLY = r"^\p{L}+$"


def join_by_id(left: DataFrame, right: DataFrame, on: str = "id") -> tuple[DataFrame, DataFrame]:
    """#27 ``join_fragments_by_id``: inner join on the row id plus the left rows without a partner."""
    return left.join(right, on, "inner"), left.join(right, on, "left_anti")


#: Longest part of a token that is joined on; the rest of a longer token is compared afterwards.
ANCHOR = 8
#: Characters of all tokens up to which they are sent to the tasks as one automaton (about 50 bytes each there).
MATCHER_CHARS = 2_000_000
#: Words of a block of rows, distinct in each row, which one task holds with the tokens in them.
BLOCK_WORDS = 500_000


def containment_join(cands: DataFrame, docs: DataFrame, lower: bool = True, letters_only: bool = False) -> DataFrame:
    """#30 ``containment_join``: (token, id) for every doc whose text contains the token, whatever its length.

    ``cands(token)``; ``docs(id, text)`` with unique ids.  One row for each element of ``contained_tokens``.
    """
    found = contained_tokens(cands, docs.select("id", "text"), lower, letters_only)
    return found.select(F.explode("tokens").alias("token"), "id")


def contained_tokens(cands: DataFrame, docs: DataFrame, lower: bool = True, letters_only: bool = False, value: str = "token") -> DataFrame:
    """``docs(id, text, ...)``, ids unique, with the column ``tokens`` in place of the text: the distinct tokens of ``cands(token)`` in it.

    The tokens are written once and counted.  Up to MATCHER_CHARS characters they go to the tasks as one Aho–Corasick
    automaton, and a row is searched where it lies: no text and no pair is shuffled.  More tokens than that are joined
    to the distinct words by their first characters (``_contained``), and rows meet their words' tokens in blocks
    (``_tokens_of_words``), with the same result.  ``letters_only`` states that every token is a
    letter run (e.g. word-regex tokens): then the distinct words are searched instead of the whole text.
    ``value`` names another string column of ``cands`` whose distinct values are given in place of the tokens.

    Defined results: a null text holds nothing, an empty token is in every other text, a null token in none.
    """
    text = F.lower(F.col("text")) if lower else F.col("text")
    cands = cands.where(F.col("token").isNotNull()).select("token", F.col(value).alias("value")).distinct()
    cands = written(cands, "tokens")
    chars = cands.agg(F.sum(F.char_length("token"))).first()[0] or 0
    keep = [c for c in docs.columns if c != "text"]
    if chars <= MATCHER_CHARS:
        parts = F.array_distinct(T.word_tokens(text, lower=False)) if letters_only else F.array(text)
        searched = docs.select(*keep, F.when(F.col("text").isNotNull(), parts).alias("tokens"))
        return match_tokens(searched, [tuple(r) for r in cands.collect()])
    letter = F.col("token").rlike(LETTERS_ONLY)
    found = _tokens_of_words(cands.where(letter), docs, text)
    other = cands.where(~letter)
    if letters_only and other.isEmpty():
        return found
    pairs = _other_pairs(other, docs, text).groupBy("id").agg(F.collect_set("value").alias("_other"))
    empty = F.array().cast("array<string>")
    return found.join(pairs, "id", "left").select(*keep, F.array_union("tokens", F.coalesce("_other", empty)).alias("tokens"))


def _other_pairs(cands: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """(value, id) of tokens that aren't letter runs: they are searched in the texts, and an empty one is in each."""
    every = docs.where(F.col("text").isNotNull()).select(F.lit("").alias("token"), "id").join(cands, "token").select("value", "id")
    some = cands.where(F.col("token") != "")
    via_texts = _contained(some.select("token").distinct(), docs.select(F.col("id").alias("key"), text.alias("text")))
    return via_texts.join(some, "token").select("value", F.col("key").alias("id")).unionByName(every)


def _tokens_of_words(cands: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """``contained_tokens`` for letter runs, ``cands(token, value)``, which distinct words hold whole.

    Rows are dealt into blocks of about BLOCK_WORDS words.  What a word holds comes once to each block that has the
    word, not once to each row, and a row's tokens are put together where it lies: no (token, id) pair is shuffled.
    """
    keep = [c for c in docs.columns if c != "text"]
    words = F.coalesce(F.array_distinct(T.word_tokens(text, lower=False)), F.array().cast("array<string>"))
    # written: a row keeps its number
    rows = written(docs.select(*keep, words.alias("tokens"), F.monotonically_increasing_id().alias("_row")), "rows")
    n = (rows.agg(F.sum(F.size("tokens"))).first()[0] or 0) // BLOCK_WORDS + 1
    rows = rows.select(*keep, "tokens", F.pmod("_row", F.lit(n)).alias("_block"))
    in_blocks = written(rows.select("_block", F.explode("tokens").alias("key")).distinct(), "block-words")
    held = _contained(cands.select("token").distinct(), in_blocks.select("key", F.col("key").alias("text")).distinct())
    held = held.join(cands, "token").groupBy("key").agg(F.collect_set("value").alias("held"))
    held = in_blocks.join(held, "key").select(F.col("_block").alias("_of"), "key", "held")
    return put_together(rows, held, [f for f in rows.schema if f.name in keep])


def _contained(cands: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, token): the non-empty tokens that each of ``texts(key, text)`` holds.

    An equi-join on the first ``ANCHOR`` characters (fewer for shorter tokens): every place of a text gives one piece
    per anchor length that the tokens have.  Rows carry key and place only; where a longer token begins, the rest is
    compared after the text is joined back.
    """
    cands = cands.where(F.col("token") != "").withColumn("_anchor", F.left("token", F.lit(ANCHOR)))
    # At most ANCHOR different numbers.
    lengths = sorted(r[0] for r in cands.select(F.char_length("_anchor")).distinct().collect())
    if not lengths:
        return texts.select("key", F.lit("").alias("token")).limit(0)
    chars = texts.select("key", F.split("text", "").alias("_chars"))
    places = chars.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_chars"), F.lit(1)))).alias("at"))
    anchored = places.withColumn("_length", F.explode(F.array(*[F.lit(n) for n in lengths])))
    anchored = anchored.where(F.col("at") + F.col("_length") - 1 <= F.size("_chars"))
    pieces = anchored.select("key", "at", F.array_join(F.slice("_chars", F.col("at"), F.col("_length")), "").alias("_anchor"))
    begun = pieces.join(cands, "_anchor").select("key", "at", "token")
    whole = F.char_length("token") <= ANCHOR
    rest = begun.where(~whole).join(texts, "key").where(F.substring("text", F.col("at"), F.char_length("token")) == F.col("token"))
    return begun.where(whole).select("key", "token").unionByName(rest.select("key", "token")).distinct()


def group_argmax(df: DataFrame, group: list[str], order_col: str, tie: str, desc: bool = True) -> DataFrame:
    """#41: the row with the max (min) value per group, the smallest ``tie`` on ties.

    An aggregate (``max_by`` / ``min_by`` over the whole row), so it is
    combined map-side and a group holding most of the rows is no hot task.
    ``tie`` must be numeric (it is negated for the max)."""
    row = F.struct(*[F.col(c) for c in df.columns])
    if desc:
        pick = F.max_by(row, F.struct(F.col(order_col), -F.col(tie)))
    else:
        pick = F.min_by(row, F.struct(F.col(order_col), F.col(tie)))
    return df.groupBy(*group).agg(pick.alias("_r")).select("_r.*")


def zip_rank_join(a: DataFrame, b: DataFrame, keys: list[str], va: str, vb: str, order_a: str, order_b: str) -> DataFrame:
    """#33: positional zip of two lists (per key), truncated to the shorter."""
    wa = Window.partitionBy(*keys).orderBy(F.col(order_a))
    wb = Window.partitionBy(*keys).orderBy(F.col(order_b))
    ra = a.select(*keys, F.col(va).alias("a"), F.row_number().over(wa).alias("rank"))
    rb = b.select(*keys, F.col(vb).alias("b"), F.row_number().over(wb).alias("rank"))
    return ra.join(rb, [*keys, "rank"], "inner")


def pad_rank_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """#34: full outer join on (keys, rank), missing side = 0."""
    return a.join(b, [*keys, "rank"], "full_outer").select(
        *keys, "rank", F.coalesce(F.col("a"), F.lit(0.0)).alias("a"), F.coalesce(F.col("b"), F.lit(0.0)).alias("b")
    )


def token_sets(sets: DataFrame) -> DataFrame:
    """``(id, tokens)``: the sorted distinct tokens of every id that has one.

    ``sets`` has a row for each (id, token), or for each text (id, tokens array).  Arrays stay where their rows lie
    unless an id repeats: only then the rows of an id are brought together.
    """
    if "token" in sets.columns:
        return sets.groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    rows = sets.select("id", F.array_sort(F.array_distinct("tokens")).alias("tokens")).where(F.size("tokens") > 0)
    if sets.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"))


def _signed(sets: DataFrame) -> DataFrame:
    return token_sets(sets).withColumn("_sig", F.unhex(F.sha2(F.array_join("tokens", "\u0001"), 256)))


def _classes(signed: DataFrame) -> DataFrame:
    return signed.groupBy("_sig").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"))


def collapse_identical_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group rows whose token sets are identical.

    ``sets`` of ``token_sets`` → (``reps(id, tokens, n)`` one row per
    distinct set, represented by its smallest id; ``copies(id, m)`` the
    multiplicity of every represented set).  A group of copies, however
    large, becomes one row before any pairing.  Copies are counted by their signatures alone.
    """
    per = _signed(sets)
    grp = _classes(per)
    reps = per.join(grp.select("_sig", "id"), ["_sig", "id"], "left_semi").select("id", "tokens", F.size("tokens").alias("n"))
    return reps, grp.select("id", "m")


def similarity_members(sets: DataFrame) -> DataFrame:
    """(id, rep): every row and the smallest id among the rows with the same token set (the id that ``similarity_self_join`` reports)."""
    per = _signed(sets).select("id", "_sig")
    return per.join(per.groupBy("_sig").agg(F.min("id").alias("rep")), "_sig").select("id", "rep")


def similarity_self_join(sets: DataFrame, threshold: float = 0.6, copies_only: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """#31 exact Jaccard self-join: pairs of distinct token sets with J > threshold (above 0).

    Tokens are ordered by ascending frequency of their hash's slot.  When the first shared token of sets of n_a ≤ n_b
    tokens stands at ranks (i, j), they share at most 1 + min(n_a − i, n_b − j) tokens, and J > num / den takes more
    than num · (n_a + n_b) / (num + den).  So a set is met only on its first tokens, fewer as the smaller of two than as
    the larger one, and sets of one template that stay below the threshold don't meet on the template's tokens.  Sets
    that meet are compared by signatures, one bit per hashed token (modulo 2): each bit that differs stands for a token
    of one set only.  Both are done in blocks (``setpairs``), so pairs that fall away never leave their task.  All
    bounds are exact, in integer arithmetic; what they leave is compared token by token.

    Identical sets are collapsed first and reported with their multiplicity, so copies never produce quadratic
    pairs; ``similarity_members`` tells which rows each id stands for.
    Returns (pairs(id_a, id_b, n_common, n_union, jaccard), copies(id, m)); pairs are found when this is called, and
    are None with ``copies_only``.
    """
    num, den = _ratio(threshold)
    if num <= 0:
        raise ValueError("threshold must be above 0")
    reps, copies = collapse_identical_sets(sets)
    if copies_only:
        return None, copies
    reps = written(reps.where(F.col("n") > 0), "sets")
    cand = written(similarity_candidates(reps, num, den), "candidates")
    # exact test J > t on integers: inter * den > num * union for t = num / den
    out = compared(cand, reps).where(F.col("n_common") * F.lit(den) > F.lit(num) * F.col("n_union"))
    return out.withColumn("jaccard", F.col("n_common") / F.col("n_union")), copies


def similarity_candidates(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(task, id_a, id_b), id_a < id_b, of ``reps(id, tokens, n)`` that the bounds of ``similarity_self_join`` leave."""
    return candidates(reps, num, den)


def _ratio(t: float) -> tuple[int, int]:
    from fractions import Fraction

    f = Fraction(t).limit_denominator(10**6)
    return f.numerator, f.denominator
