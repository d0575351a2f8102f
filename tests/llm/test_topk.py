import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from spindle.llm import topk


def brute(data, k, scale=64):
    import math

    best = {}
    for i, v in data:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(scale * x) for x in v]
        best[i] = min(best[i], q) if i in best else q
    out = []
    for i, v in best.items():
        if i % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in best.items() if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("dim, n, k", [(8, 300, 7), (3, 40, 50), (1, 30, 4)])
def test_matches_brute_force(spark, monkeypatch, dim, n, k):
    monkeypatch.setattr(topk, "CAND_BLOCK", 37)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 11)
    rng = random.Random(dim)
    data = [(i, [rng.choice([-0.5, 0.25, rng.gauss(0, 0.3)]) for _ in range(dim)]) for i in range(n)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    import struct

    as_float = [(i, [struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in data]
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k).collect())
    assert got == brute(as_float, k)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.0], 1), (5, [1.0, 0.0], 2), (1, [1.0], 3), (2, None, 4), (3, [nan, 1.0], 5), (4, [inf, 1.0], 6),
        (6, [None, 1.0], 7), (7, [], 8), (8, [1.0, 0.0], 9), (8, [1.0, 0.0], 9), (None, [1.0, 1.0], 10), (10, [1.0, 0.0, 3.0], 11),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score int").withColumn("rank", F.lit(1)).withColumn("block", F.lit(2))
    got = rows(topk.top_k(df, F.col("vec_id") % 5 == 0, 20))
    assert {r["vec_id"] for r in got} == {0, 1, 5, 7, 8, 10}
    first = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0)
    assert first == [(1, 1, 4096), (2, 5, 4096), (3, 8, 4096), (4, 10, 4096), (5, 7, 0)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 5 == 0, 3).collect() == []


def test_large_values_are_exact(spark):
    data = [(0, [2.0**40, 1.0]), (5, [2.0**20, -1.0]), (1, [2.0**40, 0.5])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 5, 2, scale=1).collect())
    assert got == [(5, 1, 1, 2**60), (5, 2, 0, 2**60 - 1)]
