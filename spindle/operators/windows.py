"""Ranking and running-sum operators without single-partition windows.

A global running sum (ROC curves, midranks, exact-size splits) is computed
as: range-partition by (group, order) → write the rows with their partition's
number → running sum inside each range partition → add the total of all earlier
partitions of the same group (a table of #partitions rows).  A hot group is thus
spread over many range partitions instead of landing in one window task.  The
partition numbers are written with the rows, because a second evaluation of the
range exchange could sample other bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import with_group_stats, written


def _n_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def ordered_cumsum(
    df: DataFrame,
    order: list,
    value: Column | str | None = None,
    group: tuple = (),
    out: str = "cum",
    n_parts: int | None = None,
) -> DataFrame:
    """Running sum of ``value`` (default 1) over ``order`` within ``group`` (rows frame).

    ``order`` must be a total order inside each group (end it with a key).
    """
    g = list(group)
    v = F.lit(1).cast("bigint") if value is None else (F.col(value) if isinstance(value, str) else value)
    n = n_parts or _n_parts(df)
    keyed = written(df.withColumn("_v", v).repartitionByRange(n, *g, *order).withColumn("_pid", F.spark_partition_id()), "ranges")
    totals = keyed.groupBy(*g, "_pid").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*g, "_pid", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_pid", *g).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.withColumn("_loc", F.sum("_v").over(local))
        .join(offsets, [*g, "_pid"])
        .withColumn(out, F.col("_loc") + F.col("_off"))
        .select(*[c for c in df.columns if c != out], out)
    )


def ordinal_index(df: DataFrame, order: list, group: tuple = (), out: str = "idx") -> DataFrame:
    """0-based consecutive row index in a total order within each group."""
    return ordered_cumsum(df, order, None, group, out).withColumn(out, F.col(out) - 1)


def value_counts(df: DataFrame, value: str, group: tuple = (), weight: str | None = None) -> DataFrame:
    """Rows per distinct (group, value): the pre-aggregation behind every rank operator."""
    aggs = [F.count(F.lit(1)).alias("cnt")]
    if weight:
        aggs.append(F.sum(weight).alias("wsum"))
    return df.groupBy(*group, value).agg(*aggs)


def midrank(df: DataFrame, value: str, group: tuple = (), out: str = "midrank") -> DataFrame:
    """#53: 1-based rank by ``value`` where ties get the mean rank of their block.

    Two-step: count rows per distinct value (partial aggregation absorbs hot
    values), running count over the distinct values, join back.
    """
    g = list(group)
    vc = value_counts(df, value, group)
    ranked = ordered_cumsum(vc, [F.col(value)], "cnt", group, "_cum").select(
        *g, value, (F.col("_cum") - (F.col("cnt") - 1) / 2.0).alias(out)
    )
    return df.join(ranked, [*g, value])


def midrank_weighted(df: DataFrame, value: str, weight: str, key: str, group: tuple = (), out: str = "midrank_w") -> DataFrame:
    """#54: mean of the cumulative weight over each tie block, rows ordered by (value, key)."""
    g = list(group)
    cum = ordered_cumsum(df, [F.col(value), F.col(key)], weight, group, "_cw")
    block = cum.groupBy(*g, value).agg(F.avg("_cw").alias(out))
    return cum.drop("_cw").join(block, [*g, value])


def quantiles(df: DataFrame, value: str, probs: dict[str, float], group: tuple = (), weight: str | None = None) -> DataFrame:
    """Exact quantiles by group, interpolated linearly: one row per group with a column per name in ``probs``.

    Rows are counted per distinct value first (``weight``: a whole number of
    times that a row counts), the counts get a running sum over the values, and
    a quantile lies between the two values whose runs of ranks hold its lower
    and upper rank.  No task holds a group's values: a hot value is one count,
    and a group of many values is spread over the ranges of the running sum.

    Null values and rows of weight 0 or null don't count; a group without any
    has nulls.  NaN is the largest value.
    """
    assert all(0 <= q <= 1 for q in probs.values()), "a quantile's share lies between 0 and 1"
    n = F.coalesce(F.col(weight), F.lit(0)) if weight else F.lit(1)
    rows = df.select(_group_key(group).alias("_g"), F.col(value).cast("double").alias("_x"), n.cast("bigint").alias("_n"))
    counts = rows.groupBy("_g", "_x").agg(F.sum(F.when(F.col("_x").isNotNull(), F.col("_n")).otherwise(0)).alias("_cnt"))
    cum = ordered_cumsum(counts, [F.col("_x")], "_cnt", ("_g",), "_cum")
    runs = cum.join(cum.groupBy("_g").agg(F.max("_cum").alias("_total")), "_g")
    first = F.col("_cum") - F.col("_cnt")
    at = lambda rank: F.max(F.when((first <= rank) & (rank < F.col("_cum")), F.col("_x")))
    parts, out = [], []
    for i, (name, q) in enumerate(probs.items()):
        rank = F.lit(float(q)) * (F.col("_total") - 1)
        parts += [at(F.floor(rank)).alias(f"_lo{i}"), at(F.ceil(rank)).alias(f"_hi{i}"), F.max(rank - F.floor(rank)).alias(f"_share{i}")]
        lo, hi, share = (F.col(f"_{x}{i}") for x in ("lo", "hi", "share"))
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * share).alias(name))
    found = runs.groupBy("_g").agg(*parts)
    return found.select(*[F.col("_g")[f"g{i}"].alias(c) for i, c in enumerate(group)], *out)


def _group_key(group: tuple) -> Column:
    """The group columns as one struct: structs with equal nulls are equal, so null groups join, too."""
    return F.struct(F.lit(0).alias("one"), *[F.col(c).alias(f"g{i}") for i, c in enumerate(group)])


def with_quantiles(stats: DataFrame, quants: DataFrame, group: tuple = ()) -> DataFrame:
    """``stats`` with the columns of ``quants``, both one row per group."""
    if not group:
        return with_group_stats(stats, quants, [])
    right = quants.select(_group_key(group).alias("_g"), *[c for c in quants.columns if c not in group])
    return stats.withColumn("_g", _group_key(group)).join(right, "_g", "left").drop("_g")


def roc_curve(pred: DataFrame, score: str = "p", label: str = "y", group: tuple = ()) -> DataFrame:
    """#57: per distinct threshold (desc): cumulative tp, fp and the rates."""
    g = list(group)
    per = pred.groupBy(*g, score).agg(
        F.sum(F.col(label)).cast("bigint").alias("pos"),
        F.sum(F.lit(1) - F.col(label)).cast("bigint").alias("neg"),
    )
    totals = per.groupBy(*g).agg(F.sum("pos").alias("_npos"), F.sum("neg").alias("_nneg"))
    c = ordered_cumsum(per, [F.col(score).desc()], "pos", group, "tp")
    c = ordered_cumsum(c, [F.col(score).desc()], "neg", group, "fp")
    c = with_group_stats(c, totals, g)
    return c.select(
        *g,
        F.col(score).alias("threshold"),
        F.col("tp").cast("bigint").alias("tp"),
        F.col("fp").cast("bigint").alias("fp"),
        F.try_divide(F.col("tp"), F.col("_npos")).alias("tpr"),
        F.try_divide(F.col("fp"), F.col("_nneg")).alias("fpr"),
    )


def pr_curve_auc(pred: DataFrame, score: str = "p", label: str = "y", group: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """#58: precision/recall at each distinct threshold and the trapezoid area.

    The curve starts at (recall 0, precision 1); points are ordered by
    threshold descending and joined to their predecessor by index (an
    equi-join, not a global lag window).
    """
    g = list(group)
    roc = roc_curve(pred, score, label, group)
    pts = roc.select(
        *g, "threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.col("tpr").alias("recall")
    )
    idx = ordinal_index(pts, [F.col("threshold").desc()], group, "k")
    prev = idx.select(*g, (F.col("k") + 1).alias("k"), F.col("precision").alias("p0"), F.col("recall").alias("r0"))
    seg = idx.join(prev, [*g, "k"], "left").select(
        *g,
        ((F.col("recall") - F.coalesce("r0", F.lit(0.0))) * (F.col("precision") + F.coalesce("p0", F.lit(1.0))) / 2.0).alias("a"),
    )
    area = seg.groupBy(*g).agg(F.sum("a").alias("pr_auc"))
    return pts, area
