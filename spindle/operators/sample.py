"""Reproducible splits, sampling and augmentation.

Randomness is an md5 of ``seed:key…`` so results are identical across
engines and re-runs (a recomputed task after an executor loss draws the same
values).  Exact-size cuts use the range-partitioned ordinal index instead of
a single-partition ``row_number``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import ship_package
from .md5 import first_words
from .rowwise import as_token_rows, kept_tokens, with_words
from .util import with_group_stats
from .windows import ordered_cumsum, ordinal_index


def _with_total(df: DataFrame, group: list[str], out: str = "_n") -> DataFrame:
    tot = df.groupBy(*group).agg(F.count(F.lit(1)).alias(out))
    return with_group_stats(df, tot, group)


def random_split(df: DataFrame, seed: int = 42, test_frac: float = 0.1, key: str = "id") -> DataFrame:
    """#105: exactly ceil(test_frac · n) rows (smallest md5(seed:id)) are 'test', the rest 'train'."""
    d = df.withColumn("_h", T.md5_rank_key(seed, key))
    d = ordinal_index(d, [F.col("_h"), F.col(key)], (), "_i")
    d = _with_total(d, [])
    split = F.when(F.col("_i") < F.ceil(F.col("_n") * F.lit(test_frac)), F.lit("test")).otherwise(F.lit("train"))
    return d.withColumn("split", split).drop("_h", "_i", "_n")


def stratified_split(df: DataFrame, label: str, fractions=(0.8, 0.1, 0.1), seed: int = 40, key: str = "id") -> DataFrame:
    """#106: per label, rows ordered by md5(seed:id) and cut at floor(f_train·n_l) and
    floor((f_train+f_valid)·n_l): label ratios are kept in every part."""
    assert abs(sum(fractions) - 1.0) < 1e-9, "fractions must sum to 1"
    d = df.withColumn("_h", T.md5_rank_key(seed, key))
    d = ordinal_index(d, [F.col("_h"), F.col(key)], (label,), "_i")
    d = _with_total(d, [label])
    c1 = F.floor(F.col("_n") * F.lit(fractions[0]))
    c2 = F.floor(F.col("_n") * F.lit(fractions[0] + fractions[1]))
    split = F.when(F.col("_i") < c1, "train").when(F.col("_i") < c2, "valid").otherwise("test")
    return d.withColumn("split", split).drop("_h", "_i", "_n")


def group_disjoint_split(df: DataFrame, group: str, fractions=(0.8, 0.1, 0.1)) -> DataFrame:
    """#107: whole groups go to one part.  Groups ordered by (size desc, key);
    a group is 'train' while the cumulative size ≤ f_train·n, 'valid' while
    ≤ (f_train+f_valid)·n, else 'test'."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    cum = ordered_cumsum(sizes, [F.col("_size").desc(), F.col(group)], "_size", (), "_cum")
    cum = cum.withColumn("_n", cum.agg(F.sum("_size")).scalar())
    split = (
        F.when(F.col("_cum") <= F.col("_n") * F.lit(fractions[0]), "train")
        .when(F.col("_cum") <= F.col("_n") * F.lit(fractions[0] + fractions[1]), "valid")
        .otherwise("test")
    )
    return df.join(cum.select(group, split.alias("split")), group)


def rotate_words(words: Column, k: Column) -> Column:
    """Variant k of a token array: rotated left by k mod n (n = 0 → empty)."""
    n = F.size(words)
    s = F.when(n > 0, k % n).otherwise(F.lit(0))
    return F.when(n > 0, F.concat(F.slice(words, s + 1, n - s), F.slice(words, 1, s))).otherwise(words)


def variant_expand(df: DataFrame, f: int = 3, text: str = "text", key: str = "id") -> DataFrame:
    """#109: every row → f deterministic variants (token rotations 1…f)."""
    w = T.word_tokens(text)
    return df.select(key, w.alias("_w"), F.explode(F.sequence(F.lit(1), F.lit(f))).alias("k")).select(
        key, "k", F.array_join(rotate_words(F.col("_w"), F.col("k")), " ").alias("variant")
    )


def oversample_minority(spark, df: DataFrame, label: str = "label", factor: int = 1, seed: int = 40, text: str = "text", key: str = "id") -> DataFrame:
    """#108: draw (n_major − n_minor·f) // f minority rows with replacement, make a
    rotation variant of each draw, keep distinct variants, label them minority.

    The draw count is one scalar; the draws themselves are ``spark.range``
    (distributed), joined to the minority rows by md5 index."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return df.limit(0).select(key, F.lit(None).cast("string").alias("variant"), F.col(label))
    minority = min(counts, key=lambda k: (counts[k], -k))
    major = max(counts.values())
    n_min = counts[minority]
    needed = (major - n_min * factor) // factor
    mino = ordinal_index(df.where(F.col(label) == minority).select(key, text), [F.col(key)], (), "_i")
    if needed <= 0:
        return mino.limit(0).select(key, F.lit(None).cast("string").alias("variant"), F.lit(minority).alias(label))
    draws = spark.range(needed).select(
        F.col("id").alias("draw"), (T.md5_int(seed, F.col("id")) % F.lit(n_min)).alias("_i")
    )
    j = draws.join(mino, "_i")
    w = T.word_tokens(text)
    rot = T.md5_int(seed, F.col("draw"), F.lit("r"))
    v = j.select(key, F.array_join(rotate_words(w, rot), " ").alias("variant"))
    return v.distinct().withColumn(label, F.lit(minority))


def perturb_keep_fraction(tok: DataFrame, reps: int = 3, frac: float = 0.9, seed: int = 42) -> DataFrame:
    """#110: per (row, rep) keep max(1, int(frac·n)) tokens chosen by md5 rank, in
    original order.  ``tok``: rows of ``token_rows`` or a long (id, pos, token) → (id, rep, tokens).

    A row's tokens are ranked where the row lies: they are neither repeated nor shuffled per repetition."""
    return kept_tokens(as_token_rows(tok, ["id"]), ["id"], reps, frac, seed)


def perturbed_rows(rows: DataFrame, reps: int, frac: float = 0.9, seed: int = 42) -> DataFrame:
    """Rows of ``token_rows`` with the same ``reps`` copies as ``perturb_keep_fraction``, known by what they drop."""
    return with_words(rows, ["id"], reps, frac, seed)


def perturb_replace_token(tok: DataFrame, seed: int = 42) -> DataFrame:
    """#111: per row, the token at the md5-smallest position is replaced everywhere
    by the md5-smallest *other* distinct token of the row (none → unchanged).
    ``tok``: rows of ``token_rows`` or a long (id, pos, token) → (id, target, replacement, tokens)."""
    rows = as_token_rows(tok, ["id"]).where(F.col("id").isNotNull())
    first = F.array_min(F.transform("_t", lambda x: F.struct(T.md5_rank_key(seed, "id", x["pos"]), x["token"].alias("t"))))["t"]
    t = rows.select("id", F.arrays_zip("pos", F.col("tokens").alias("token")).alias("_t"), "tokens").withColumn("target", first)
    others = F.filter(F.array_distinct("tokens"), lambda x: x != F.col("target"))
    other = F.array_min(F.transform(others, lambda x: F.struct(T.md5_rank_key(seed, "id", x), x.alias("t"))))["t"]
    t = t.withColumn("replacement", other)
    changed = lambda x: F.when((x == F.col("target")) & F.col("replacement").isNotNull(), F.col("replacement")).otherwise(x)
    # rows that share an id repeat positions: there the new tokens decide the order
    placed = F.array_sort(F.transform("_t", lambda x: F.struct(x["pos"].alias("pos"), changed(x["token"]).alias("t"))))
    return t.select("id", "target", "replacement", placed["t"].alias("tokens"))


def poisson_thresholds(k_max: int = 12) -> list[float]:
    """Cumulative Poisson(1) probabilities P(X ≤ k), k = 0 … k_max-1, from the formula
    e^-1 Σ_{j≤k} 1/j! (the last class k_max takes the remaining mass)."""
    out, term, acc = [], math.exp(-1.0), 0.0
    for k in range(k_max):
        acc += term
        out.append(acc)
        term /= k + 1
    return out


def poisson_weight(u: Column, k_max: int = 12) -> Column:
    """Inverse-CDF draw of a Poisson(1) count from a uniform u in [0, 1)."""
    w = None
    for k, c in enumerate(poisson_thresholds(k_max)):
        w = F.when(u < F.lit(c), F.lit(k)) if w is None else w.when(u < F.lit(c), F.lit(k))
    return w.otherwise(F.lit(k_max))


def bootstrap_ci(
    values: DataFrame, value: str, key: str = "id", group: tuple = (), reps: int = 10000, seed: int = 40, lo: float = 0.025, hi: float = 0.975
) -> DataFrame:
    """#112: percentile interval of the mean over ``reps`` bootstrap resamples.

    Poisson bootstrap: in resample r every row enters w ~ Poisson(1) times,
    w drawn from md5(seed:group:r:key).  Each resample mean is
    Σ w·x / Σ w (a resample with Σ w = 0 is empty and skipped).  A task draws a row's weights for all
    resamples at once and adds them up, so the shuffle holds one partial per (partition, group) with a sum
    per resample — no row-level join and no gathering of a group in one task."""
    g = list(group) or ["_all"]
    v = values if group else values.withColumn("_all", F.lit(0))
    ship_package(values.sparkSession)
    head = F.concat_ws("|", *[F.col(c).cast("string") for c in g])
    drawn = v.select(*g, F.concat_ws(":", F.lit(str(seed)), head, F.lit("")).alias("_head"), F.col(key).cast("string").alias("_key"), F.col(value).cast("double").alias("_x"))
    sums = resample_sums(drawn, g, reps)
    slots = sums.select(*g, F.posexplode(F.arrays_zip("wx", "w")).alias("rep", "s"))
    means = slots.groupBy(*g, "rep").agg(F.try_divide(F.sum("s.wx"), F.sum("s.w")).alias("m"))
    point = v.groupBy(*g).agg(F.avg(value).alias("mean"))
    ci = means.groupBy(*g).agg(F.percentile("m", lo).alias("ci_lo"), F.percentile("m", hi).alias("ci_hi"))
    out = point.join(ci, g)
    return out if group else out.drop("_all")


def resample_sums(drawn: DataFrame, group: list[str], reps: int) -> DataFrame:
    """(group..., wx, w): of the rows of a task, Σ weight · value and Σ weight for each of ``reps`` resamples.

    ``drawn(group..., _head, _key, _x)``: a row's weight in resample r is drawn from md5(_head, r[, ':', _key]).
    A null value counts in the second sum only."""
    limits = [math.ceil(c * 2**32) for c in poisson_thresholds()]  # k / 2^32 < c for integers k < limit
    schema = StructType([*(drawn.schema[c] for c in group), StructField("wx", ArrayType(DoubleType())), StructField("w", ArrayType(LongType()))])

    def add_up(batches):
        sums, names = {}, {}
        for b in batches:
            heads, keys, xs = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_head", "_key", "_x"))
            by: dict = {}
            of = list(zip(*(b.column(i).to_pylist() for i in range(len(group))), strict=True))
            for i, (h, k) in enumerate(zip(heads, keys, strict=True)):
                names.setdefault(of[i], b.slice(i, 1).select(group))
                tail = b"" if k is None else b":" + k.encode()
                by.setdefault((of[i], h, len(tail)), []).append((tail, xs[i]))
            for (name, h, _), rows in by.items():
                if name not in sums:
                    sums[name] = [np.zeros(reps), np.zeros(reps, np.int64), np.zeros(reps, bool)]
                wx, w, some = sums[name]
                x = np.array([math.nan if r[1] is None else r[1] for r in rows])
                known = np.array([r[1] is not None for r in rows])
                for first, rows_at, words in first_words(h.encode(), [r[0] for r in rows], reps):
                    weight = poisson_counts(words, limits)
                    to = slice(first, first + words.shape[1])
                    w[to] += weight.sum(axis=0, dtype=np.int64)
                    has = known[rows_at]
                    wx[to] += x[rows_at][has] @ weight[has]
                    some[to] |= has.any()
        for name, (wx, w, some) in sums.items():
            columns = [pa.array([wx], pa.list_(pa.float64()), from_pandas=False), pa.array([w], pa.list_(pa.int64()))]
            if not some.all():  # no value at all: the sum is null
                columns[0] = pa.array([[x if s else None for x, s in zip(wx.tolist(), some.tolist(), strict=True)]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*names[name].columns, *columns], names=[*group, "wx", "w"])

    return drawn.mapInArrow(add_up, schema)


def poisson_counts(words: np.ndarray, limits: list[int]) -> np.ndarray:
    """Poisson counts of 32-bit draws: how many of the cumulative limits each one reaches (as ``poisson_weight``)."""
    out = np.zeros(words.shape, np.uint8)
    for c in limits:
        out += words >= np.uint64(c) if c >= 2**32 else words >= np.uint32(c)
    return out
