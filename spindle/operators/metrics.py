"""Classification metrics as grouped aggregates.

Input: a predictions table with a 0/1 label ``y`` and two logits ``l0, l1``
(hard prediction = l1 > l0) or a probability score; optional weight ``w``.
Every metric is one aggregate per group, so all (tokenizer, task) groups are
evaluated in one job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import with_group_stats
from .windows import midrank

# Fixed values
Z_975 = 1.959963984540054  # two-sided 95 % normal quantile
# Chebyshev fit of erfc(x) = t·exp(−x² + P(t)), t = 1 / (1 + x/2): coefficients of P, lowest order first
ERFC_COEFFS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def hard_pred(l0: str = "l0", l1: str = "l1") -> Column:
    return F.when(F.col(l1) > F.col(l0), F.lit(1)).otherwise(F.lit(0))


def confusion(pred: DataFrame, group: tuple = (), weight: str | None = None) -> DataFrame:
    """#113: TP FP TN FN (weighted when ``weight`` is given)."""
    yhat = hard_pred()
    w = F.col(weight) if weight else F.lit(1)
    y = F.col("y")

    def s(cond):
        out = F.sum(F.when(cond, w).otherwise(F.lit(0)))
        return out if weight else out.cast("bigint")

    return pred.groupBy(*group).agg(
        s((y == 1) & (yhat == 1)).alias("tp"),
        s((y == 0) & (yhat == 1)).alias("fp"),
        s((y == 0) & (yhat == 0)).alias("tn"),
        s((y == 1) & (yhat == 0)).alias("fn"),
    )


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def rates(conf: DataFrame) -> DataFrame:
    """#114-#118 from a confusion table."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    pos, neg = tp + fn, tn + fp
    tpr, tnr = _safe_div(tp, pos), _safe_div(tn, neg)
    prec1, prec0 = _safe_div(tp, tp + fp), _safe_div(tn, tn + fn)
    f1_1 = _safe_div(2 * prec1 * tpr, prec1 + tpr)
    f1_0 = _safe_div(2 * prec0 * tnr, prec0 + tnr)
    po = (tp + tn) / n
    pe = ((tp + fp) * pos + (tn + fn) * neg) / (n * n)
    # PR area on hard predictions: points (0,1), (recall, precision) at threshold 1, (1, P/n)
    base = pos / n
    pr_area = F.when(
        tp + fp > 0,
        tpr * (F.lit(1.0) + prec1) / 2.0 + (F.lit(1.0) - tpr) * (prec1 + base) / 2.0,
    ).otherwise((F.lit(1.0) + base) / 2.0)
    return conf.select(
        "*",
        po.alias("accuracy"),
        ((tpr + tnr) / 2.0).alias("balanced_accuracy"),
        ((prec1 * pos + prec0 * neg) / n).alias("precision_w"),
        ((tpr * pos + tnr * neg) / n).alias("recall_w"),
        ((f1_1 * pos + f1_0 * neg) / n).alias("f1_w"),
        F.when(pe != 1, (po - pe) / (F.lit(1.0) - pe)).otherwise(F.lit(0.0)).alias("kappa"),
        ((tpr + tnr) / 2.0).alias("auc_hard"),
        pr_area.alias("auc_prc_hard"),
    )


def class_weights(df: DataFrame, label: str = "y", group: tuple = ()) -> DataFrame:
    """#39: balanced weight n / (k * n_c) per (group, label)."""
    g = list(group)
    per = df.groupBy(*g, label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = per.groupBy(*g).agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    j = with_group_stats(per, tot, g)
    return j.select(*g, label, F.col("n_c").cast("bigint").alias("n_c"), (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight"))


def delong(pred: DataFrame, score: str = "p", group: tuple = ()) -> DataFrame:
    """#119: AUC from midranks and its DeLong variance, per group.

    AUC = Σ_pos rank_all / (m n) − (m + 1) / (2 n);
    V01_i = (rank_all_i − rank_pos_i) / n over positives,
    V10_j = 1 − (rank_all_j − rank_neg_j) / m over negatives,
    var = var_samp(V01) / m + var_samp(V10) / n.  One-class groups → null.
    """
    if not group:
        return delong(pred.withColumn("_all", F.lit(0)), score, ("_all",)).drop("_all")
    g = list(group)
    base = pred.select(*g, "id", "y", F.col(score).alias("_s"))
    allr = midrank(base, "_s", group, "tz")
    own = midrank(base, "_s", (*g, "y"), "tc")
    r = allr.join(own.select(*g, "id", "tc"), [*g, "id"])
    mn = base.groupBy(*g).agg(
        F.sum(F.col("y")).cast("double").alias("m"), F.sum(F.lit(1) - F.col("y")).cast("double").alias("n")
    )
    r = r.join(mn, g)
    pos = F.col("y") == 1
    v01 = F.when(pos, F.try_divide(F.col("tz") - F.col("tc"), F.col("n")))
    v10 = F.when(~pos, F.lit(1.0) - F.try_divide(F.col("tz") - F.col("tc"), F.col("m")))
    out = r.groupBy(*g).agg(
        F.first("m").alias("m"),
        F.first("n").alias("n"),
        F.sum(F.when(pos, F.col("tz"))).alias("_sz"),
        F.var_samp(v01).alias("_v01"),
        F.var_samp(v10).alias("_v10"),
    )
    valid = (F.col("m") > 0) & (F.col("n") > 0)
    auc = F.when(valid, F.try_divide(F.col("_sz"), F.col("m") * F.col("n")) - F.try_divide(F.col("m") + 1.0, 2.0 * F.col("n")))
    var = F.when(valid, F.try_divide(F.col("_v01"), F.col("m")) + F.try_divide(F.col("_v10"), F.col("n")))
    return out.select(*g, F.col("m").cast("bigint").alias("n_pos"), F.col("n").cast("bigint").alias("n_neg"), auc.alias("auc"), var.alias("auc_var"))


def delong_ci(d: DataFrame, z: float = Z_975) -> DataFrame:
    """#120: normal interval, upper end clipped at 1 (lower end left as is)."""
    half = F.lit(z) * F.sqrt(F.col("auc_var"))
    return d.withColumn("auc_lb", F.col("auc") - half).withColumn("auc_ub", F.least(F.lit(1.0), F.col("auc") + half))


def normal_sf(z: Column) -> Column:
    """Upper-tail normal probability 1 - Φ(z) for z ≥ 0 as a column expression.

    erfc by the Numerical-Recipes Chebyshev fit (relative error < 1.2e-7), so it
    stays a JVM expression instead of a Python UDF.
    """
    x = z / math.sqrt(2.0)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    coeffs = ERFC_COEFFS
    poly = F.lit(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        poly = F.lit(c) + t * poly
    erfc = t * F.exp(-x * x + poly)
    return erfc / 2.0


def log10_two_sided_p(z: Column) -> Column:
    """log10 of the two-sided normal probability of z, in logs throughout: it doesn't underflow for large z."""
    x = F.abs(z) / math.sqrt(2.0)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = F.lit(c) + t * poly
    return F.log10(t) + (poly - x * x) / F.lit(math.log(10.0))


def delong_test(pred: DataFrame, s1: str = "p", s2: str = "p2", group: tuple = ()) -> DataFrame:
    """#121: paired DeLong test of two scores on the same rows → z and log10 two-sided p."""
    if not group:
        return delong_test(pred.withColumn("_all", F.lit(0)), s1, s2, ("_all",)).drop("_all")
    g = list(group)
    base = pred.select(*g, "id", "y", F.col(s1).alias("a"), F.col(s2).alias("b"))
    comps = []
    for name in ("a", "b"):
        allr = midrank(base.select(*g, "id", "y", name), name, group, f"tz_{name}")
        own = midrank(base.select(*g, "id", "y", name), name, (*g, "y"), f"tc_{name}")
        comps.append(allr.join(own.select(*g, "id", f"tc_{name}"), [*g, "id"]).select(*g, "id", "y", f"tz_{name}", f"tc_{name}"))
    r = comps[0].join(comps[1], [*g, "id", "y"])
    mn = base.groupBy(*g).agg(F.sum("y").cast("double").alias("m"), F.sum(F.lit(1) - F.col("y")).cast("double").alias("n"))
    r = r.join(mn, g)
    pos = F.col("y") == 1
    cols = []
    for nm in ("a", "b"):
        cols.append(F.when(pos, F.try_divide(F.col(f"tz_{nm}") - F.col(f"tc_{nm}"), F.col("n"))).alias(f"v01_{nm}"))
        cols.append(F.when(~pos, F.lit(1.0) - F.try_divide(F.col(f"tz_{nm}") - F.col(f"tc_{nm}"), F.col("m"))).alias(f"v10_{nm}"))
        cols.append(F.when(pos, F.col(f"tz_{nm}")).alias(f"sz_{nm}"))
    r = r.select(*g, "m", "n", *cols)
    agg = r.groupBy(*g).agg(
        F.first("m").alias("m"),
        F.first("n").alias("n"),
        F.sum("sz_a").alias("sza"),
        F.sum("sz_b").alias("szb"),
        F.var_samp("v01_a").alias("va01"),
        F.var_samp("v10_a").alias("va10"),
        F.var_samp("v01_b").alias("vb01"),
        F.var_samp("v10_b").alias("vb10"),
        F.covar_samp("v01_a", "v01_b").alias("c01"),
        F.covar_samp("v10_a", "v10_b").alias("c10"),
    )
    m, n = F.col("m"), F.col("n")
    auc_a = F.try_divide(F.col("sza"), m * n) - F.try_divide(m + 1.0, 2.0 * n)
    auc_b = F.try_divide(F.col("szb"), m * n) - F.try_divide(m + 1.0, 2.0 * n)
    var_diff = F.try_divide(F.col("va01") + F.col("vb01") - 2 * F.col("c01"), m) + F.try_divide(F.col("va10") + F.col("vb10") - 2 * F.col("c10"), n)
    z = F.try_divide(auc_a - auc_b, F.sqrt(var_diff))
    return agg.select(
        *g,
        auc_a.alias("auc_1"),
        auc_b.alias("auc_2"),
        z.alias("z"),
        log10_two_sided_p(z).alias("log10_p"),
    )


def logloss_ppl(pred: DataFrame, group: tuple = ()) -> DataFrame:
    """#122: mean −ln p(true class) with its standard error (ddof 1) and 95 % t-interval, perplexity =
    exp(mean) with its interval, and the smoothed perplexity exp(mean / n).

    Probabilities below ``P_FLOOR`` count as that."""
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("l0") - F.col("l1")))
    p_true = F.when(F.col("y") == 1, p1).otherwise(F.lit(1.0) - p1)
    nll = -F.log(F.greatest(p_true, F.lit(P_FLOOR)))
    out = pred.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(nll).alias("logloss"),
        (F.stddev_samp(nll) / F.sqrt(F.count(F.lit(1)))).alias("sem"),
        F.exp(F.avg(nll)).alias("perplexity"),
    )
    half = t_975(F.col("n") - 1) * F.col("sem")
    out = out.withColumn("logloss_lb", F.col("logloss") - half).withColumn("logloss_ub", F.col("logloss") + half)
    return out.withColumns(
        {
            "perplexity_lb": F.exp("logloss_lb"),
            "perplexity_ub": F.exp("logloss_ub"),
            "smoothed_perplexity": F.exp(F.col("logloss") / F.col("n")),
        }
    )


#: Smallest probability in a logarithm.
P_FLOOR = 1e-15


_z = Z_975
#: Coefficients of 1 / df, 1 / df^2, ... in the series of the quantile.
T_SERIES = (
    (_z**3 + _z) / 4,
    (5 * _z**5 + 16 * _z**3 + 3 * _z) / 96,
    (3 * _z**7 + 19 * _z**5 + 17 * _z**3 - 15 * _z) / 384,
    (79 * _z**9 + 776 * _z**7 + 1482 * _z**5 - 1920 * _z**3 - 945 * _z) / 92160,
)


def t_975(df: Column) -> Column:
    """0.975 quantile of Student's t by the Cornish–Fisher series in 1 / df (error below 1e-4 from 10 degrees on; null below 1)."""
    out = F.lit(Z_975)
    for k, c in enumerate(T_SERIES, 1):
        out = out + F.lit(c) / F.pow(df.cast("double"), F.lit(float(k)))
    return F.when(df >= 1, out)
