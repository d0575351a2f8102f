"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node hangs on the smallest of the node and its neighbours."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours hang on the smallest of them (edges have a > b)."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of the edges (a, b) that isn't the smallest of its component, that smallest node.

    Alternating large and small stars (each a grouping and a join, no group
    is collected) until the edges don't change; a number of rounds in the
    order of the logarithm of the longest path.  Every round is written to the
    checkpoint folder.  Self-loops, repeated edges and both directions are
    fine, ids may be any long; no edges: no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    # Order-free sums of hashes; ids themselves would overflow a long.
    trace = [F.sum((F.xxhash64(F.lit(i), "a", "b") % 2_147_483_647).cast("decimal(38,0)")) for i in range(2)]
    before = None
    while True:
        e = written(_small_star(_large_star(e)), "components")
        now = tuple(e.agg(F.count(F.lit(1)), *trace).first())
        if now == before or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
