"""Row cleaning, validation and simple relational helpers.

All operators are single-pass column expressions or one aggregation; the
keep-first dedupe is an aggregate (map-side combined), not a window, so a
group of copies holding a large share of the rows never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def dedupe_keep_first(df: DataFrame, key: list[str], order: str = "id") -> DataFrame:
    """#13: one row per key: the one with the smallest ``order`` value.

    ``min(struct(order, ...))`` is combined partially before the shuffle.
    """
    rest = [c for c in df.columns if c not in key and c != order]
    first = df.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("_r"))
    return first.select(*key, *[F.col(f"_r.{c}").alias(c) for c in [order, *rest]]).select(*df.columns)


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """#14: drop rows with a null in any (or the given) column."""
    return df.na.drop(how="any", subset=subset)


def _count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def validate_quarantine(df: DataFrame, text: str = "text", pattern: str = T.TEXT_TOKEN_PATTERN, lower: bool = True) -> DataFrame:
    """#19: one pass of three validity predicates → (…, ok, reason).

    * lexable: the tokens of ``pattern`` re-join to the text without whitespace;
    * balanced ``()`` and ``[]`` counts;
    * an even number of ring-closure digits.
    The first failing predicate is the reason; passing rows have reason null.
    """
    t = F.lower(F.col(text)) if lower else F.col(text)
    lexable = F.array_join(T.all_matches(t, pattern), "") == F.regexp_replace(t, r"\s", "")
    balanced = (_count_char(t, "(") == _count_char(t, ")")) & (_count_char(t, "[") == _count_char(t, "]"))
    even = (F.length(F.regexp_replace(t, "[^0-9]", "")) % 2) == 0
    reason = (
        F.when(~lexable, F.lit("not_lexable"))
        .when(~balanced, F.lit("unbalanced_brackets"))
        .when(~even, F.lit("odd_ring_digits"))
    )
    return df.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def clean_string(text) -> Column:
    """#20: strip, ``\\\\`` → ``\\``, then drop every ``\\`` and ``*``."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    t = F.replace(t, F.lit("\\\\"), F.lit("\\"))
    t = F.replace(t, F.lit("\\"), F.lit(""))
    return F.replace(t, F.lit("*"), F.lit(""))


def filter_known_tokens(rows: DataFrame, tok_ids: DataFrame, key: str, unk_id: int, text: str = "text") -> DataFrame:
    """#22: rows with no [UNK] token and no backslash.

    ``tok_ids(key, tid)``: rows having an unknown token are removed by an
    anti-join on their ids (no per-row array scan)."""
    bad = tok_ids.where(F.col("tid") == unk_id).select(key).distinct()
    return rows.join(bad, key, "left_anti").where(~F.col(text).contains("\\"))


def relabel(col, mapping: dict) -> Column:
    """#24: value remap; unmapped values stay."""
    c = F.col(col) if isinstance(col, str) else col
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(c) if out is not None else c


def assert_partition_sizes(
    splits: DataFrame, source: DataFrame, label: str, split: str = "split", fractions: dict | None = None, tol: float = 1e-9
) -> DataFrame:
    """#26: one row of checks in one aggregate: the parts sum to the source
    size, ids are disjoint across parts, fractions sum to 1, labels ⊆ {0, 1}.
    ``raise_if_failed`` turns it into an error."""
    parts = splits.select("id", F.col(label).alias("_y"), F.col(split).alias("_s"), F.lit(1).alias("_part"))
    whole = source.select("id", F.lit(None).cast("int").alias("_y"), F.lit(None).cast("string").alias("_s"), F.lit(0).alias("_part"))
    is_part = F.col("_part") == 1
    agg = parts.unionByName(whole).agg(
        F.sum("_part").alias("sum_parts"),
        F.sum(F.lit(1) - F.col("_part")).alias("n_source"),
        F.countDistinct(F.when(is_part, F.col("id"))).alias("n_ids"),
        F.countDistinct(F.when(is_part, F.col("_s"))).alias("n_parts"),
        F.sum(F.when(is_part & ~F.col("_y").isin(0, 1), 1).otherwise(0)).alias("bad_labels"),
    )
    frac_ok = abs(sum((fractions or {"_": 1.0}).values()) - 1.0) <= tol
    return agg.select(
        F.col("n_source").cast("bigint").alias("n_source"),
        F.col("sum_parts").cast("bigint").alias("sum_parts"),
        F.col("n_parts").cast("bigint").alias("n_parts"),
        (F.col("sum_parts") == F.col("n_source")).alias("sizes_ok"),
        (F.col("n_ids") == F.col("sum_parts")).alias("disjoint_ok"),
        F.lit(frac_ok).alias("fractions_ok"),
        (F.col("bad_labels") == 0).alias("labels_ok"),
    )


def raise_if_failed(checks: DataFrame) -> DataFrame:
    """Turn failed checks into a query error (``raise_error``) when evaluated."""
    ok = F.col("sizes_ok") & F.col("disjoint_ok") & F.col("fractions_ok") & F.col("labels_ok")
    return checks.withColumn("_chk", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("partition size check failed"))))
