"""Operator 9, personal data by candidate gradient boosting, in DataFrame functions and Spark ML only.

Generators (regular expressions with high recall) propose spans, which may
overlap.  Boosted trees score every candidate from its format (lengths, digit
groups, separators) and its context (keywords before it, neighbouring
characters).  They are trained on the corpus itself: a candidate is a positive
example if it passes its kind's full check (``_valid``).  Length and digit count
are features and decide some of these checks, so the trees mostly repeat them.
For each kind the smallest threshold whose held-out precision
reaches ``PRECISION`` on at least ``EVIDENCE`` candidates is chosen, and
candidates at or above it are redacted, unless a checksum (cards) or range
(addresses) rules them out.  A kind without such a threshold is redacted where
its full check passes.
The base spans (base pattern and check) stay whatever the trees say.

A fifth of all candidates, of every kind, is held out.  The trees learn from
about ``TRAIN_ROWS`` of the others, drawn by hash and dealt out over the kinds
and labels so that rare ones come in whole.  All candidates are scored, and the
thresholds are set on all that are held out.

Places are counted without any per-match copy of the text: the matches of a
pattern are wrapped in two control characters, the text is split there, and
the lengths of the parts are summed.  Texts are read once; what is kept are
candidates with a little context and one row per document.

Defined results
* null or empty text: no spans; null doc_id: kept as null
* equal rows (id and text): one result each; rows that share only the id: apart
* an added span that overlaps a base span or an earlier added span that stays is
  dropped (earlier: by start, then longer, then kind)
* candidates of one class only: those that pass their full check are added; empty table: no rows
* very long texts: linear time in each generator; other columns are ignored
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, read_table, row_key, written

TRAIN_ROWS, PRECISION, EVIDENCE = 20_000, 0.95, 20
TREES, DEPTH = 12, 4

KINDS = ("email", "ip", "card", "phone", "secret", "id")
# The base patterns.  Look-behinds and possessive repeats keep the leftmost matches and make the search linear.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "0-9"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", "0-9"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
#: Further generators: (kind, pattern, what a text must hold).
MORE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]{2,24}){1,3}", "at"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9.])", "0-9"),
    ("card", r"(?<![0-9])[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{1,7}(?![0-9])", "0-9"),
    ("phone", r"(?<![0-9+(-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9])", "0-9"),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16,}+|(?:password|passwd|token|secret|api[_-]?key) ?[=:] ?\"?[A-Za-z0-9+/_-]{8,}+(?:\.[A-Za-z0-9+/_-]++)*+={0,2}+)", "0-9"),
    ("id", r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])", "0-9"),
)
OPEN, CLOSE = "\x01", "\x02"
CONTEXT = 24


def _pieces(text: Column, pattern: str, needs: str, digits: Column) -> Column:
    """The text split before each match, each match closed by ``CLOSE``; null without a match."""
    held = {"0-9": digits, "at": text.rlike(r"[\[({]at[\])}]")}.get(needs, F.contains(text, F.lit(needs)))
    marked = F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}")
    return F.when(held, F.when(F.contains(marked, F.lit(OPEN)), F.split(marked, OPEN, -1)))


def proposals(docs: DataFrame) -> DataFrame:
    """(_k, doc_id, found): one row per document, with the matches of every generator and the lengths between them."""
    rows = row_key(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    odd = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    rows = rows.select("_k", "doc_id", F.when(odd, F.translate(text, OPEN + CLOSE, "\x03\x03")).otherwise(text).alias("_t"))
    rows = rows.withColumn("_digits", F.col("_t").rlike("[0-9]"))
    generators = [*BASE, *MORE]
    rows = rows.select("_k", "doc_id", *[_pieces(F.col("_t"), p, needs, F.col("_digits")).alias(f"_g{g}") for g, (_, p, needs) in enumerate(generators)])

    def matches(g: int) -> Column:
        parts = F.col(f"_g{g}")

        def one(i: Column) -> Column:
            gap = F.substring_index(parts[i - 1], CLOSE, -1)
            return F.struct(
                F.lit(g).alias("gen"),
                i.alias("i"),
                F.char_length(gap).alias("gap"),
                F.substring_index(parts[i], CLOSE, 1).alias("m"),
                F.right(gap, F.lit(CONTEXT)).alias("before"),
                F.left(F.substring_index(parts[i], CLOSE, -1), F.lit(2)).alias("after"),
            )

        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), one))

    empty = "array<struct<gen:int,i:int,gap:int,m:string,before:string,after:string>>"
    each = [F.coalesce(matches(g), F.array().cast(empty)) for g in range(len(generators))]
    return rows.select("_k", "doc_id", F.concat(*each).alias("found"))


def candidates(found: DataFrame) -> DataFrame:
    """(_k, kind, base, start, stop, m, before, after, valid): every proposed span, by code points from 0, stop exclusive."""
    generators = [*BASE, *MORE]
    each = found.where(F.size("found") > 0).dropDuplicates(["_k"]).select("_k", F.inline("found"))
    order = Window.partitionBy("_k", "gen").orderBy("i")
    gaps = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.coalesce(F.sum(F.char_length("m")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kind = F.element_at(F.array(*[F.lit(k) for k, _, _ in generators]), F.col("gen") + 1)
    spans = each.withColumn("start", (gaps + earlier).cast("bigint")).withColumn("kind", kind).withColumn("d", F.regexp_replace("m", "[^0-9]", ""))
    return spans.select(
        "_k",
        "kind",
        (F.col("gen") < len(BASE)).alias("base"),
        "start",
        (F.col("start") + F.char_length("m")).cast("bigint").alias("stop"),
        "m",
        "before",
        "after",
        F.coalesce(_valid(), F.lit(False)).alias("valid"),
    )


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid() -> Column:
    """The full check of a candidate's kind, from its text ``m`` and digits ``d``."""
    n = F.char_length("d")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    checks = {
        "email": F.lit(True),
        "ip": F.col("m").rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": F.when(n.between(12, 19), _luhn(F.col("d"))).otherwise(False),
        "phone": n.between(9, 15),
        "secret": F.col("m").rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]") & (F.char_length("m") >= 16),
        "id": F.col("m").rlike(r"^[A-Z]{2}[0-9]{2}|^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"),
    }
    out = F.lit(None).cast("boolean")
    for kind, check in checks.items():
        out = F.when(F.col("kind") == kind, check).otherwise(out)
    return out


def featured(spans: DataFrame) -> DataFrame:
    """Add the features f0, f1, ... of format and context."""
    m, before, after = F.col("m"), F.lower("before"), F.col("after")
    n = F.char_length(m)
    only = lambda chars: F.char_length(F.regexp_replace(m, f"[^{chars}]", ""))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    words = {"phone": "tel|phone|call|fax|mobil", "email": "mail|contact|write", "card": "card|visa|pay|iban|konto|account", "ip": r"\bip|host|server|addr", "secret": "key|token|pass|secret|auth", "id": "ssn|social|passport|ident"}
    f = [
        n, only("0-9"), only("A-Za-z"), only("A-Z"), only(r"\x20"), only("-"), only("."), only("()"), F.size(groups),
        F.array_max(F.transform(groups, lambda g: F.char_length(g))),
        F.array_min(F.transform(groups, lambda g: F.char_length(g))),
        m.startswith("+"), m.startswith("0"), F.contains(m, F.lit("@")), F.size(F.array_distinct(F.split(m, ""))) / n,
        m.rlike("^(?:19|20)[0-9]{2}(?![0-9])"),
        before.rlike("[a-z]$"), before.rlike(r"[0-9]\W?$"), before.rlike(r"[=:#]\s?\"?$"), before.rlike("[$€£]\\s?$"),
        after.rlike("^[A-Za-z]"), after.rlike(r"^\W?[0-9]"), after.rlike("^[%$€£]"),
        *[before.rlike(f"(?:{w})[^0-9]*$") for w in words.values()],
        *[F.col("kind") == k for k in KINDS],
    ]
    return spans.withColumns({f"f{i}": F.coalesce(x.cast("double"), F.lit(0.0)) for i, x in enumerate(f)})


def _features(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[:1] == "f" and c[1:].isdigit()]


def scored(spans: DataFrame) -> DataFrame:
    """(_k, kind, start, stop, base, valid, chosen): whether the boosted trees' score reaches the kind's threshold."""
    keep = ["_k", "kind", "start", "stop", "base", "valid"]
    held = F.pmod(F.xxhash64("_k", "start", "m"), F.lit(5)) == 0
    model = _trees(spans.where(~held))
    if model is None:
        return spans.select(*keep, F.col("valid").alias("chosen"))
    df = featured(spans.withColumn("held", held))
    inputs = VectorAssembler(inputCols=_features(df), outputCol="features", handleInvalid="keep")
    score = vector_to_array("probability")[1]
    done = written(model.transform(inputs.transform(df)).select(*keep, "held", score.alias("score")), "pii-scored")
    buckets = done.where("held").groupBy("kind", F.floor(F.col("score") * 20).cast("int").alias("bucket"))
    thresholds = _thresholds(buckets.agg(F.sum(F.col("valid").cast("double")).alias("good"), F.count(F.lit(1)).alias("n")).collect())
    # A checksum or range that fails rules a candidate out, whatever its form.
    possible = F.col("valid") | ~F.col("kind").isin("card", "ip")
    chosen = F.col("valid")
    for kind, t in thresholds.items():
        chosen = F.when(F.col("kind") == kind, possible & (F.col("score") >= t)).otherwise(chosen)
    return done.select(*keep, chosen.alias("chosen"))


def _trees(spans: DataFrame) -> GBTClassificationModel | None:
    """Boosted trees fitted on about TRAIN_ROWS candidates.  None if there is nothing to learn from."""
    counts = {(r["kind"], r["valid"]): r["count"] for r in spans.groupBy("kind", "valid").count().collect()}
    if len({label for _, label in counts}) < 2:
        return None
    order = ("_k", "start", "stop", "kind", "base")
    draw = F.pmod(F.xxhash64(*order), F.lit(1 << 31))
    taken = F.lit(False)
    for (kind, label), n in _shares(counts, TRAIN_ROWS).items():
        group = (F.col("kind") == kind) & (F.col("valid") == label)
        taken = F.when(group, draw < F.lit(-(-(n << 31) // counts[kind, label]))).otherwise(taken)
    df = featured(spans.where(taken).repartition(1).sortWithinPartitions(*order))
    inputs = VectorAssembler(inputCols=_features(df), outputCol="features", handleInvalid="keep")
    sample = written(inputs.transform(df).select("features", F.col("valid").cast("double").alias("label")), "pii-sample")
    rows = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1, 1.0 / rows[1.0]).otherwise(1.0 / rows[0.0]) * (sum(rows.values()) / 2)
    # Each class weighs the same: rare kinds of errors count, and the thresholds are set on held-out rows as they are.
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, weightCol="weight", cacheNodeIds=False)
    return trees.fit(sample.withColumn("weight", weight).coalesce(1))


def _shares(counts: dict, total: int) -> dict:
    """How many rows of each group to take: as equal as the groups' sizes let them be, ``total`` in all."""
    out, left = {}, total
    for i, (group, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[group] = min(n, left // (len(counts) - i))
        left -= out[group]
    return out


def _thresholds(buckets: list) -> dict[str, float]:
    """Per kind the smallest lower edge of a bucket from which the precision reaches PRECISION on EVIDENCE rows or more."""
    out: dict[str, float] = {}
    for kind in {b["kind"] for b in buckets}:
        good = n = 0.0
        for b in sorted((b for b in buckets if b["kind"] == kind), key=lambda b: -b["bucket"]):
            good, n = good + b["good"], n + b["n"]
            if n >= EVIDENCE and good / n >= PRECISION:
                out[kind] = b["bucket"] / 20
    return out


def chosen_spans(found: DataFrame) -> DataFrame:
    """(_k, kind, start, stop, base): the base spans, and the added ones that overlap none of them nor each other."""
    spans = written(candidates(found), "pii-candidates")
    keep = ["_k", "kind", "start", "stop"]
    base = spans.where("base AND valid").select(*keep, F.lit(True).alias("base"))
    extra = scored(spans).where("chosen").where(~(F.col("base") & F.col("valid"))).select(*keep, F.lit(False).alias("base")).distinct()
    both = base.unionByName(extra)
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    order = Window.partitionBy("_k").orderBy("start", F.col("stop").desc(), F.col("base").desc(), rank)
    back = Window.partitionBy("_k").orderBy(F.col("start").desc(), "stop", "base", rank.desc())
    before = lambda c: F.max(c).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    free = both.withColumn("_before", before(F.when(F.col("base"), F.col("stop")))).withColumn("_after", after)
    free = free.where(F.col("base") | ((F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.coalesce("_after", F.col("stop")) >= F.col("stop"))))
    return free.where("base").select(*keep, "base").unionByName(_apart(free.where("NOT base").select(*keep, rank.alias("rank"))))


def _apart(spans: DataFrame) -> DataFrame:
    """(_k, kind, start, stop, base): of added spans that overlap, in order, those that begin where the last one kept has ended."""
    order = Window.partitionBy("_k").orderBy("start", F.col("stop").desc(), "rank")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.coalesce(reach, F.lit(0)) <= F.col("start")).cast("int")
    # A chain: spans each of which overlaps an earlier one; spans of different chains never overlap.
    chains = spans.withColumn("_opens", opens).withColumn("_chain", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct("start", (-F.col("stop")).alias("back"), "rank", "kind")
    chains = chains.groupBy("_k", "_chain").agg(F.array_sort(F.collect_list(span)).alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        fits = s["start"] >= acc["at"]
        return F.struct(
            F.when(fits, -s["back"]).otherwise(acc["at"]).alias("at"),
            F.when(fits, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"),
        )

    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(chains.schema["spans"].dataType).alias("kept"))
    kept = chains.select("_k", F.inline(F.aggregate("spans", none, step, lambda acc: acc["kept"])))
    return kept.select("_k", "kind", "start", (-F.col("back")).alias("stop"), F.lit(False).alias("base"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: _k (see ``row_key``), doc_id, spans array<(start, kind_no, stop, base)> in order."""
    found = written(proposals(docs), "pii-found")
    kind_no = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    grouped = chosen_spans(found).groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("start", kind_no.alias("kind_no"), "stop", "base"))).alias("spans"))
    return found.select("_k", "doc_id").join(grouped, "_k", "left")


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"], s["stop"])), ","), F.lit(""))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base counts, the digest of the base spans, all spans."""
    df = find_personal_data(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda i: F.coalesce(F.size(F.filter("spans", lambda s: s["base"] & (s["kind_no"] == i))), F.lit(0)).cast("bigint")
    df = df.withColumn("spans", F.coalesce("spans", F.array().cast(df.schema["spans"].dataType)))
    return df.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[: len(BASE)])],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; spans that overlap are replaced together.

    Rows are kept; only ``text`` changes.
    """
    key, spans = free_name(docs, "_pii_key"), free_name(docs, "_pii_spans")
    marks = find_personal_data(docs).where("spans IS NOT NULL").select(F.col("_k").alias(key), F.col("spans").alias(spans)).dropDuplicates([key])
    rows = row_key(docs, key=key).join(marks, key, "left")
    text, names = F.col("text"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # (place reached, text so far): what stands before a span, then its mark unless it begins inside an earlier one.
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        parts = F.when(new, F.concat(acc["out"], F.array(gap, F.element_at(names, s["kind_no"] + 1)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), parts.alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    clean = F.when(F.col(spans).isNotNull(), F.aggregate(spans, start, step, finish)).otherwise(text)
    return rows.select(*[clean.alias("text") if c == "text" else F.col(c) for c in docs.columns])
