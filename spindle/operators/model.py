"""Models: bigram language model, log-odds scorer, Spark ML classifier.

The GPU transformer of the reference is re-aimed to models whose training is
a handful of aggregations, so a 100 TB corpus trains in one pass:
* a bigram LM with add-k smoothing (counts per (prev, token));
* a log-odds token scorer (counts per (token, label)) — linear, so its
  attributions have closed forms (see ``explain``);
* a class-weighted logistic regression on token counts (Spark ML).
Global totals enter expressions as scalar subqueries (``DataFrame.scalar``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .util import written

BOS, EOS, UNK = "<s>", "</s>", "<unk>"


def _bigrams(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    w = T.word_tokens(text)
    toks = F.concat(w, F.array(F.lit(EOS)))
    prevs = F.concat(F.array(F.lit(BOS)), w)
    return rows.select(key, F.posexplode(F.arrays_zip(prevs.alias("prev"), toks.alias("token"))).alias("pos", "b")).select(
        key, "pos", F.col("b.prev").alias("prev"), F.col("b.token").alias("token")
    )


def train_bigram_lm(train: DataFrame, key: str = "id", text: str = "text", k: float = 0.5) -> tuple[DataFrame, DataFrame, Column]:
    """#130: returns (bigram table (prev, token, n, logp), prev totals (prev, n_prev), V).

    p(w | v) = (c(v, w) + k) / (c(v) + k·V), V = distinct training tokens + 1 (<unk>).

    The texts are read once: the counts are written, and totals and vocabulary come from them."""
    counts = written(_bigrams(train, key, text).groupBy("prev", "token").agg(F.count(F.lit(1)).alias("n")), "bigrams")
    prev_tot = counts.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    v = (counts.select("token").distinct().agg(F.count(F.lit(1)) + F.lit(1)).scalar())
    model = counts.join(prev_tot, "prev").withColumn(
        "logp", F.log((F.col("n") + F.lit(k)) / (F.col("n_prev") + F.lit(k) * v))
    )
    return model.select("prev", "token", "n", "logp"), prev_tot, v


def score_bigrams(heldout: DataFrame, train: DataFrame, key: str, text: str = "text", k: float = 0.5) -> DataFrame:
    """Per heldout bigram: logp under the model; unseen tokens become <unk>."""
    model, prev_tot, v = train_bigram_lm(train, key, text, k)
    vocab = model.select(F.col("token").alias("t")).distinct()  # of the written counts
    bg = _bigrams(heldout, key, text)

    def known(col):
        return F.when(F.col(col).isin(BOS) | F.col(f"_{col}_known").isNotNull(), F.col(col)).otherwise(F.lit(UNK))

    bg = bg.join(vocab.withColumnRenamed("t", "prev").withColumn("_prev_known", F.lit(1)), "prev", "left")
    bg = bg.join(vocab.withColumnRenamed("t", "token").withColumn("_token_known", F.lit(1)), "token", "left")
    bg = bg.select(key, "pos", known("prev").alias("prev"), known("token").alias("token"))
    j = bg.join(model.select("prev", "token", "n"), ["prev", "token"], "left").join(prev_tot, "prev", "left")
    logp = F.when(
        F.col("n_prev").isNull(), -F.log(v.cast("double"))
    ).otherwise(F.log((F.coalesce("n", F.lit(0)) + F.lit(k)) / (F.col("n_prev") + F.lit(k) * v)))
    return j.select(key, "pos", "prev", "token", logp.alias("logp"))


def sentence_loss(scored: DataFrame, key: str) -> DataFrame:
    """#131: per row Σ ln p and exp(−Σ / n)."""
    return scored.groupBy(key).agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("logp").alias("sum_logp")).withColumn(
        "ppl", F.exp(-F.col("sum_logp") / F.col("n_tokens"))
    )


def masked_positions(scored: DataFrame, key: str, p: float = 0.15, seed: int = 42) -> Column:
    return (T.md5_int(seed, F.col(key), F.col("pos")) / F.lit(4294967296.0)) < F.lit(p)


def loss_per_position(scored: DataFrame, key: str, p: float = 0.15, seed: int = 42) -> DataFrame:
    """#132: mean −ln p over the md5-selected (masked) positions, their number and exp(loss)."""
    m = scored.where(masked_positions(scored, key, p, seed))
    return m.groupBy(key).agg(F.count(F.lit(1)).alias("n_masked"), F.avg(-F.col("logp")).alias("loss")).withColumn(
        "ppl", F.exp("loss")
    )


def corpus_perplexity(scored: DataFrame, key: str, p: float = 0.15, seed: int = 42) -> DataFrame:
    """#133: the six corpus-level perplexity formulas.

    One per-row aggregate (tokens, Σ ln p, masked −ln p) followed by one
    global aggregate over the rows: the scoring pipeline runs once."""
    masked = F.when(masked_positions(scored, key, p, seed), -F.col("logp"))
    per = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("logp").alias("sl"), F.sum(masked).alias("mnll"), F.count(masked).alias("nm")
    ).withColumn("ppl", F.exp(-F.col("sl") / F.col("n")))
    g = per.agg(
        F.sum("n").alias("N"),
        F.sum("sl").alias("SL"),
        F.sum("mnll").alias("M"),
        F.sum("nm").alias("NM"),
        F.sum(F.col("n") - 1).alias("W"),
        F.avg("ppl").alias("mean_ppl"),
        F.sum("ppl").alias("sum_ppl"),
    )
    return g.select(
        F.exp(F.try_divide(-F.col("SL"), F.col("N"))).alias("ppl_per_token"),
        F.exp(F.try_divide(F.col("M"), F.col("NM"))).alias("ppl_masked"),
        F.exp(-F.try_divide(F.col("SL"), F.col("W"))).alias("ppl_sen_minus"),
        F.exp(F.try_divide(F.col("SL"), F.col("W"))).alias("ppl_sen_plus"),
        F.col("mean_ppl").alias("ppl_mean"),
        F.try_divide(F.col("sum_ppl"), F.col("N")).alias("ppl_sum_per_token"),
    )


# ---------------------------------------------------------------------------
# log-odds scorer (#135) and labels (#136)
# ---------------------------------------------------------------------------

def train_log_odds(rows: DataFrame, key: str = "id", text: str = "text", label: str = "y") -> tuple[DataFrame, Column]:
    """#135: w_t = ln((tp_t+1)/(P+V)) − ln((fp_t+1)/(N+V)); prior = ln(#pos rows / #neg rows).

    Returns (weights(token, w), prior as a scalar column)."""
    tok = rows.select(key, F.col(label).alias("_y"), F.explode(T.word_tokens(text)).alias("token"))
    cnt = tok.groupBy("token").agg(
        F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("_y") == 0, 1).otherwise(0)).alias("fp")
    )
    tot = cnt.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"), F.count(F.lit(1)).alias("V"))
    P, N, V = (tot.select(c).scalar() for c in ("P", "N", "V"))
    w = cnt.select("token", (F.log((F.col("tp") + 1) / (P + V)) - F.log((F.col("fp") + 1) / (N + V))).alias("w"))
    lab = rows.agg(F.log(F.try_divide(F.sum(F.col(label)), F.sum(F.lit(1) - F.col(label)))).alias("prior"))
    return w, lab.select("prior").scalar()


def token_weights(rows: DataFrame, weights: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, pos, token, w) for every word position; unknown tokens weigh 0."""
    tok = rows.select(key, F.posexplode(T.word_tokens(text)).alias("pos", "token"))
    return tok.join(weights, "token", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def log_odds_scores(
    rows: DataFrame, weights: DataFrame, prior: Column, key: str = "id", text: str = "text", sums: DataFrame | None = None
) -> DataFrame:
    """logit = prior + Σ_positions w_token, per row (rows without tokens get the prior).

    ``sums(key, _s)``: the rows' sums of weights, where the caller has them."""
    tw = token_weights(rows, weights, key, text).groupBy(key).agg(F.sum("w").alias("_s")) if sums is None else sums
    return rows.join(tw, key, "left").withColumn("logit", prior + F.coalesce("_s", F.lit(0.0))).drop("_s")


def predict_label(scored: DataFrame, logit: str = "logit") -> DataFrame:
    """#136: two-class softmax of (0, logit), argmax, 'toxic' / 'non_toxic'."""
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(logit)))
    pred = F.when(F.col(logit) > 0, 1).otherwise(0)
    return scored.withColumn("p1", p1).withColumn("pred", pred).withColumn(
        "label_name", F.when(pred == 1, "toxic").otherwise("non_toxic")
    )


# ---------------------------------------------------------------------------
# Spark ML classifier (#134)
# ---------------------------------------------------------------------------

def train_classifier(train: DataFrame, test: DataFrame, label: str = "y", aux_label: str | None = "quality", vocab_size: int = 2000):
    """#134: class-weighted logistic regression on token counts; with ``aux_label``
    an auxiliary model is trained first and its probability is an extra feature
    of the target model (the two-stage training of the reference).

    Returns predictions ``(id, y, l0, l1)`` on ``test``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def prep(df):
        return df.withColumn("words", T.word_tokens("text"))

    tr, te = prep(train), prep(test)
    cv = CountVectorizer(inputCol="words", outputCol="tf", vocabSize=vocab_size, minDF=2.0).fit(tr)
    tr, te = cv.transform(tr), cv.transform(te)

    def weighted(df, lab):
        n = df.agg(F.count(F.lit(1))).scalar()
        per = df.groupBy(lab).agg((n / (F.lit(2.0) * F.count(F.lit(1)))).alias("_w"))
        return df.join(per, lab)

    feats = "tf"
    if aux_label:
        aux = LogisticRegression(featuresCol="tf", labelCol=aux_label, weightCol="_w", maxIter=20, regParam=0.01)
        am = aux.fit(weighted(tr, aux_label).withColumn(aux_label, F.col(aux_label).cast("double")))
        def add_aux(df):
            return am.transform(df).withColumn("aux_p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        tr, te = add_aux(tr), add_aux(te)
        va = VectorAssembler(inputCols=["tf", "aux_p"], outputCol="features")
        tr, te = va.transform(tr), va.transform(te)
        feats = "features"
    lr = LogisticRegression(featuresCol=feats, labelCol=label, weightCol="_w", maxIter=30, regParam=0.01)
    model = lr.fit(weighted(tr, label).withColumn(label, F.col(label).cast("double")))
    out = model.transform(te).withColumn("raw", vector_to_array("rawPrediction"))
    return out.select("id", F.col(label).alias("y"), F.col("raw")[0].alias("l0"), F.col("raw")[1].alias("l1"))
