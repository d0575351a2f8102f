"""Operator 12, SimHash near-duplicates by pigeonhole blocks.

A document's features are its 3-word shingles, repeats included.  Bit i of its
64-bit fingerprint is 1 if bit i is set in over half of the shingles' hashes
(XXH64, seed 42).  Documents link if their fingerprints differ in at most
``DISTANCE`` bits.

1. Documents of one fingerprint are one class, represented by its smallest id,
   so copies cost one row from here on.
2. A fingerprint is split into four blocks of 16 bits.  Two differing bits
   touch at most two blocks, so close fingerprints agree in a pair of blocks:
   six keys of 32 bits.  Fingerprints of a bucket meet in a join on the key and
   are verified by Hamming distance.
3. A bucket of more than ``BUCKET`` fingerprints isn't paired.  Its members are
   split to single bits: each gives itself and its 64 neighbours at one bit,
   and two fingerprints at distance two or less share one of these.  All that
   share a value lie within distance two of each other (verified again), so
   the smallest of them is linked with the others: a star instead of all
   pairs, and no component is lost.
4. Links give components.

Rows per fingerprint are bounded: 6 keys, 65 neighbours and 6 * BUCKET
candidates, whatever the data.

Defined results
* null, empty or blank text: fingerprint zero, linked like any other
* fewer than three words: the whole sequence is the one shingle
* equal rows: each gets the same result; a repeated doc_id: one node, which joins the classes of all its texts
* null doc_id: its fingerprint, linked with nothing, null component
* very long texts: linear, PIECE shingles at a time; empty table: no rows; other columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, read_table, slices, written
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Blocks of a fingerprint and the pairs of blocks that make a key.
BLOCK_BITS = 16
BLOCK_PAIRS = list(combinations(range(64 // BLOCK_BITS), 2))
#: Fingerprints of a bucket that are paired; larger buckets are split to single bits.
BUCKET = 64
#: Shingles hashed at a time; bytes of text worked on at a time.
PIECE, SLICE_BYTES = 1 << 16, 1 << 20


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, PIECE):
        part = words[lo : min(lo + PIECE, n) + SHINGLE - 1]
        raw = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = [0, *ends[:-1].tolist()]
        stops = (ends[min(SHINGLE, len(part)) - 1 :] - 1).tolist()
        h = np.array([xxh64_intdigest(raw[a:b], SEED) for a, b in zip(starts, stops, strict=False)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""
    schema = arrow_schema(FINGERPRINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FINGERPRINTS)


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def close_pairs(classes: DataFrame) -> DataFrame:
    """Links (a, b) between the fingerprints of ``classes(fp)`` (distinct): all pairs at DISTANCE or less, of which
    those inside crowded buckets may be replaced by a star around a third fingerprint that both are close to."""
    block = lambda i: F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    keys = [F.struct(F.lit(i).alias("pair"), (block(x) * (1 << BLOCK_BITS) + block(y)).alias("key")) for i, (x, y) in enumerate(BLOCK_PAIRS)]
    spread = classes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.pair", "k.key")
    sizes = spread.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(spread.join(sizes, ["pair", "key"]).select("pair", "key", "fp", (F.col("size") <= BUCKET).alias("small")), "simhash-buckets")
    side = lambda c: members.where("small").select("pair", "key", F.col("fp").alias(c))
    met = side("a").join(side("b"), ["pair", "key"]).where((F.col("a") < F.col("b")) & _close("a", "b")).select("a", "b")
    crowded = members.where("NOT small").select("fp").distinct()
    flips = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])).alias("value")
    # Fingerprints are signed here; any fixed order does for the centre.
    near = written(crowded.select("fp", flips), "simhash-neighbours")
    centres = near.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("_last")).where(F.col("a") < F.col("_last")).select("value", "a")
    stars = near.withColumnRenamed("fp", "b").join(centres, "value").where((F.col("a") < F.col("b")) & _close("a", "b")).select("a", "b")
    return met.unionByName(stars).distinct()


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = written(fingerprints(docs), "simhash-fingerprints")
    full = rows.where("doc_id IS NOT NULL")
    classes = written(full.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    close = close_pairs(classes.select("fp"))
    rep = lambda c: classes.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}"))
    links = close.join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    several = full.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id")
    same = full.join(several, "doc_id", "left_semi").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(same))
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    linked = full.join(named, "fp").select("doc_id", hexed, "component_id")
    return linked.unionByName(rows.where("doc_id IS NULL").select("doc_id", hexed, F.lit(None).cast("long").alias("component_id")))


def op12_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_groups(read_table(spark, sf_dir, "documents"))
