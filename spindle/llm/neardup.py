"""Operator 5, near-duplicate documents by SetSketch registers.

A document's set is its distinct 5-word shingles.  A SetSketch has M
registers; register i is the truncated, exponentially spaced minimum of an
exponential hash over the set, K_i = clip(floor(1 - log_B(min h_i)), 0, Q + 1).
Sketches merge by the larger register, and two sets share a register with
about their Jaccard similarity.

1. Each text gives its set's size, fingerprint (128 bits over the whole set)
   and sketch.  Documents of one fingerprint are one class, represented by its
   smallest id, so exact copies cost one row.
2. Classes that agree in one of ``BANDS`` bands of ``ROWS`` registers share a
   bucket.  In every bucket each class is paired with the smallest (a star).
3. A pair's similarity is estimated jointly by maximum likelihood from the
   counts of larger, smaller and equal registers and both sizes; pairs that
   can't reach the threshold (by size, or by more than six standard errors of
   the estimate) are dropped, the others are confirmed on their full sets.
4. Confirmed links give components.  Buckets whose classes lie in one
   component are settled.  The classes of all other buckets are joined exactly:
   two sets at the threshold share one of the rarest shingles of each (a
   quarter of the set and one more, by document frequency).  Only pairs of
   different components count, and a shingle of one large component and a few
   other classes meets those few only, so a group of copies that hangs
   together never gives all its pairs, and no link is lost.  Sizes and the
   shingle's places decide before the join which sets may meet, so documents of
   one template that stay below the threshold don't pair on its shingles.

A band of 4 registers agrees with probability 0.75^4 for two sets at the
threshold; all 40 bands miss such a pair with probability 2.5e-7.

Defined results
* null, empty or blank text: an empty set, size 0, linked with nothing
* fewer than five words: the whole sequence is the one shingle
* equal rows: one class; a repeated doc_id: one node, which joins the classes of all its texts; null doc_id: linked with nothing, null component and kept
* very long texts: linear, in pieces; empty table: no rows; other columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_schema, read_table, slices, written
from .components import components

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 40, 4
M = BANDS * ROWS
#: Base, rate and largest value of the registers.
B, RATE, Q = 1.001, 20.0, (1 << 16) - 2
#: Slots of the table that marks the texts a join needs.
SLOTS = 1 << 20
#: Bytes of text worked on at a time; bytes hashed at a time.
SLICE_BYTES, PIECE = 1 << 20, 1 << 22
#: Standard errors of the estimate that a pair may lie below the threshold.
ERRORS = 6

_RNG = np.random.Generator(np.random.PCG64(20_240_501))
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(int(_RNG.integers(1 << 40, 1 << 62)) * 8 + 5)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MUL = _RNG.integers(1, 1 << 32, M, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, M, dtype=np.uint32)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(int(base), len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    return out[:n]


_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each window of SHINGLE words (all words, if fewer), from prefix sums of a polynomial."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    n = len(raw)
    if len(_POW[0]) < n + 1:
        _POW[0], _POW[1] = _powers(_BASE, 2 * n + 1), _powers(_UNBASE, 2 * n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[raw] * _POW[0][:n], out=sums[1:])
    gaps = np.flatnonzero(raw == 32)
    first, last = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [n]])
    k = min(SHINGLE, len(words))
    begin, end = first[: len(first) - k + 1], last[k - 1 :]
    return _mixed((sums[end] - sums[begin]) * _POW[1][begin])


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    per = max(SHINGLE, PIECE // (1 + len(max(words, key=len))) if len(words) > 1 << 16 else len(words))
    parts = [_hashes(words[i : i + per + SHINGLE - 1]) for i in range(0, max(1, len(words) - SHINGLE + 1), per)]
    return np.unique(np.concatenate(parts))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The M registers (uint16) of a set of hashes."""
    low = np.full(M, (1 << 32) - 1, np.uint32)
    x = hashes.astype(np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, (x[i : i + 512, None] * _MUL[None, :] + _ADD[None, :]).min(axis=0), out=low)
    h = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches (rows of a and b) by joint maximum likelihood, sizes known."""
    plus, minus = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - plus - minus
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    above, below = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = plus * np.log(above + tiny) + minus * np.log(below + tiny) + equal * np.log(np.maximum(1 - above - below, 0) + tiny)
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


SKETCHES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("fp", T.BinaryType()),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def fingerprint(hashes: np.ndarray) -> bytes:
    return np.array([hashes.sum(dtype=np.uint64), _mixed(hashes + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)], np.uint64).tobytes()


def sketches(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, fp, sketch) of every row, and the string columns ``carry``."""
    out = T.StructType([*SKETCHES, *[T.StructField(c, T.StringType()) for c in carry]])
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            n, fps, regs = [], [], []
            for text in b.column(1):
                h = shingle_set(text.as_py())
                n.append(len(h))
                fps.append(fingerprint(h))
                regs.append(sketch(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(regs, pa.binary()), *b.columns[2:]], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).mapInArrow(run, out)


def _texts(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """(name, text) of at least the documents in the first column of ``ids``.

    The ids mark the slots of a table of fixed size (``SLOTS`` rows at most, so
    it may be broadcast); documents in unmarked slots aren't needed and don't
    enter the shuffle of the join that follows.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int").alias("_slot")
    marked = ids.select(slot(F.col(ids.columns[0]))).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias(name), "text").withColumn("_slot", slot(F.col(name)))
    return rows.join(F.broadcast(marked), "_slot", "left_semi").drop("_slot")


def _fits(a: str, b: str) -> Column:
    """The sizes alone allow the threshold."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimate may reach the threshold, with both fingerprints."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("fp").alias(f"fp_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_fits("n_a", "n_b")).select("a", "b", "n_a", "n_b", "fp_a", "fp_b", "s_a", "s_b")
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b")] + [T.StructField(c, T.BinaryType()) for c in ("fp_a", "fp_b")])
    schema = arrow_schema(out)
    j = PERCENT / 100
    least = j - ERRORS * (j * (1 - j) / M) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                n_a, n_b = (part.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3))
                s_a, s_b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (6, 7))
                ok = pa.array(estimate(s_a, s_b, n_a, n_b) >= least)
                yield pa.RecordBatch.from_arrays([part.column(i).filter(ok) for i in (0, 1, 4, 5)], schema=schema)

    return both.mapInArrow(run, out)


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    pairs = written(pairs, "neardup-likely")
    ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))
    side = lambda c: _texts(docs, ids, c).withColumnRenamed("text", f"t_{c}")
    texts = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fp_a", "fp_b", "t_a", "t_b")
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b")])
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s = None, None  # a centre's pairs often come together
        for batch in batches:
            good = []
            for a, b, fp_a, fp_b, t_a, t_b in zip(*batch.columns, strict=True):
                text = t_a.as_py()
                if s is None or last != text:
                    last, s = text, shingle_set(text)
                t = shingle_set(t_b.as_py())
                # A repeated id may have other texts; only those of the two classes count.
                if fingerprint(s) != fp_a.as_py() or fingerprint(t) != fp_b.as_py():
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= PERCENT * (len(s) + len(t) - both):
                    good.append((a.as_py(), b.as_py()))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*good, strict=True)], schema=schema)

    return texts.mapInArrow(run, out)


def _large(rows: DataFrame) -> DataFrame:
    """``rows`` as the side of a sort-merge join.  Spark sizes what comes from an explode by the width of its rows, not by
    their number, and would broadcast a table of many times the limit (40 keys for each class)."""
    return rows.hint("merge")


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = (), one_node: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and its string columns ``carry``.

    ``one_node``: rows with one doc_id are one document, so that the id joins the classes of all its texts; else each
    row is judged by its own text.
    """
    rows = written(sketches(docs, carry), "neardup-sketches")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(
        full.groupBy("fp", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")).withColumnRenamed("n_shingles", "n"), "neardup-classes"
    )
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("sketch", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))).alias("band", "value")
    keys = classes.select("rep", "n", band).select(F.xxhash64("band", "value").alias("key"), "rep")
    # Only buckets of several classes matter from here on.
    shared = keys.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("other")).where("centre < other").select("key", "centre")
    members = written(keys.join(_large(shared), "key").select("key", "rep", "centre"), "neardup-buckets")
    pairs = members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = _confirmed(_likely(pairs, classes), docs)
    links = written(links.unionByName(_same_ids(full, classes)) if one_node else links, "neardup-links")
    found = components(links)
    label = F.coalesce("component", F.col("rep")).alias("component")
    placed = members.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", label)
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = placed.join(_large(mixed), "key").select("rep", "component").distinct()
    left = written(left.join(classes.select("rep", "fp", "n"), "rep"), "neardup-open")
    more = written(_exact_pairs(left, docs), "neardup-pairs")
    new = written(_confirmed(more, docs), "neardup-links")
    if not new.isEmpty():
        found = components(links.unionByName(new))
    classes = classes.select("fp", F.col("n").alias("n_shingles"), "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = classes.select("fp", "n_shingles", F.coalesce("component", F.col("rep")).alias("component_id"))
    linked = full.select("doc_id", "n_shingles", "fp", *carry).join(named, ["fp", "n_shingles"]).select("doc_id", "n_shingles", "component_id", *carry)
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *carry)
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _same_ids(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) from every id that stands in several classes to the smallest ids of these."""
    several = full.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id")
    placed = full.join(several, "doc_id", "left_semi").select("doc_id", "fp", F.col("n_shingles").alias("n")).distinct()
    return placed.join(classes.select("fp", "n", "rep"), ["fp", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def _shingles(left: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, component, n, h): every shingle of the open classes."""
    texts = left.join(_texts(docs, left.select("rep"), "rep"), "rep").select("rep", "component", "n", "fp", "text")
    longs = [T.StructField(c, T.LongType()) for c in ("rep", "component", "n")]
    out = T.StructType([*longs, T.StructField("hs", T.ArrayType(T.LongType(), False))])
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            sets = [shingle_set(t.as_py()) for t in b.column(4)]
            ok = np.array([fingerprint(s) == fp.as_py() for s, fp in zip(sets, b.column(3), strict=True)], bool)
            sets = [s.view(np.int64) for s, o in zip(sets, ok, strict=True) if o]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])), type=schema.field(3).type)
            yield pa.RecordBatch.from_arrays([*(b.column(i).filter(pa.array(ok)) for i in range(3)), lists], schema=schema)

    return texts.mapInArrow(run, out).select("rep", "component", "n", F.explode("hs").alias("h"))


def _exact_pairs(left: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b, fp_a, fp_b) of different components that may reach the threshold, by prefix, size and position."""
    shingles = written(_shingles(left, docs), "neardup-shingles")
    frequent = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by_rarity = Window.partitionBy("rep").orderBy("df", "h")
    ranked = shingles.join(_large(frequent), "h").withColumn("place", F.row_number().over(by_rarity))
    ranked = ranked.withColumn("place", F.col("place") + F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("rep")))  # the others stand in one set only
    # 1-based places of the prefix: n - ceil(t n) + 1.
    prefix = written(ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).drop("df"), "neardup-prefix")
    largest = (
        prefix.groupBy("h", "component").count()
        .groupBy("h").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.count(F.lit(1)).alias("n_components"))
        .where("n_components > 1")
    )
    x = prefix.join(_large(largest.select("h", "largest")), "h")
    # The shared shingle and what follows it bound the intersection, so a partner has at most ``most`` shingles,
    # and of two sets that link at least one can have a partner of its own size ("wide").  Two narrow ones, as
    # in a family of one template below the threshold, never meet.  Sizes in bands of a third meet their neighbours.
    most = F.floor((100 + PERCENT) * (1 + F.col("n") - F.col("place")) / PERCENT) - F.col("n")
    x = x.withColumn("most", most).withColumn("wide", F.col("most") >= F.col("n")).withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / PERCENT))))
    few = F.col("component") != F.col("largest")
    near = F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band")
    x_side = lambda rows: rows.select("h", near, *[F.col(c).alias(f"{c}_x") for c in ("rep", "component", "n", "most")])
    both = (F.col("component_x") != F.col("component")) & (F.col("n") <= F.col("most_x")) & (F.col("n_x") <= F.col("most"))
    met = [
        x_side(x.where(few & F.col("wide"))).join(x, ["h", "band"]),
        x_side(x.where(few & ~F.col("wide"))).join(x.where("wide"), ["h", "band"]),
    ]
    pairs = met[0].unionByName(met[1]).where(both & _fits("n_x", "n")).select(F.least("rep", "rep_x").alias("a"), F.greatest("rep", "rep_x").alias("b")).distinct()
    side = lambda c: left.select(F.col("rep").alias(c), F.col("fp").alias(f"fp_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fp_a", "fp_b")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
