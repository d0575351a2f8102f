"""The exact cosine join against all pairs."""

import math

import numpy as np
import pytest

from spindle.operators import vectors as V

SCHEMA = "id long, v array<double>"


def _brute(rows, min_cosine):
    """Pairs of directions, copies counted, by a plain double loop."""
    dim = max((len(v) for _, v in rows if v), default=0)
    seen = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        n = math.sqrt(sum(x * x for x in v))
        seen.setdefault(tuple(x / n for x in v), []).append(i)
    reps = sorted(((min(ids), len(ids), np.pad(np.array(u), (0, dim - len(u)))) for u, ids in seen.items()), key=lambda r: r[:2])
    out = {}
    for k, (ia, ma, a) in enumerate(reps):
        for ib, mb, b in reps[k + 1 :]:
            if a @ b >= min_cosine:
                out[ia, ib] = (round(float(min(a @ b, 1.0)), 9), ma, mb)
    return out


def _got(df):
    rows = df.collect()
    out = {(r["id_a"], r["id_b"]): (round(r["cosine"], 9), r["m_a"], r["m_b"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def clustered():
    """Twelve clusters, one of which holds a third of the rows, and copies."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    which = np.where(rng.random(900) < 1 / 3, 0, rng.integers(1, 12, 900))
    x = centres[which] + 0.25 * rng.normal(size=(900, 16))
    x[50:90] = x[7]
    return [(int(i) * 10**16 - 4 * 10**18, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("min_cosine", [0.95, 0.4, -0.2])
def test_equals_all_pairs(spark, clustered, min_cosine):
    df = spark.createDataFrame(clustered, SCHEMA).repartition(5)
    want = _brute(clustered, min_cosine)
    assert len(want) > 100
    assert _got(V.cosine_pairs(df, min_cosine, pivots=8, block_rows=40)) == want


def test_result_does_not_depend_on_blocks_or_pivots(spark, clustered):
    df = spark.createDataFrame(clustered, SCHEMA)
    one = _got(V.cosine_pairs(df, 0.9, pivots=1, block_rows=10_000))
    assert _got(V.cosine_pairs(df, 0.9, pivots=20, block_rows=7, sample=60)) == one


def test_blocks_that_cannot_hold_a_pair_never_meet(spark, clustered):
    units = V.unit_vectors(spark.createDataFrame(clustered, SCHEMA)).cache()
    blocked = V.blocks(units, V.choose_pivots(units, 16, 16), 16, 40)
    sizes = [len(r["ids"]) for r in blocked.select("ids").collect()]
    assert sum(sizes) == len({tuple(v) for _, v in clustered}) and max(sizes) <= 40
    n = len(sizes)
    met = V.block_pairs(blocked, 0.95)
    assert met.distinct().count() == met.count() < n * (n + 1) / 2 / 2
    # no vector reaches the joins by a broadcast or a nested loop
    plan = V.cosine_pairs(spark.createDataFrame(clustered, SCHEMA), 0.95)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unusual_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [3.0, 4.0]), (2, [6.0, 8.0]), (3, [3.0, 4.0]), (4, [4.0, 3.0]), (5, [0.0, 0.0]), (6, None), (7, []),
        (8, [1.0, None]), (9, [nan, 1.0]), (10, [inf, 1.0]), (None, [3.0, 4.1]), (11, [3.0, 4.0, 0.1]), (12, [1.0]),
        (-(2**63), [4.0, 3.1]), (2**63 - 1, [3.1, 4.0]), (13, [-3.0, -4.0]), (13, [-3.0, -4.1]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = _brute(rows, 0.9)
    assert want[1, 4] == (0.96, 3, 1) and (13, 13) in want
    extra = df.selectExpr("id", "v", "'x' AS cell", "1 AS u", "2 AS m", "'b' AS block", "0.5 AS _n")
    for d in (df, extra):
        assert _got(V.cosine_pairs(d, 0.9, block_rows=2)) == want
    assert V.cosine_pairs(df.limit(0), 0.9).collect() == []
    assert V.cosine_pairs(df.where("id = 5"), 0.9).columns == ["id_a", "id_b", "cosine", "m_a", "m_b"]
    assert V.cosine_pairs(df.where("id = 1"), 0.9).collect() == []


def test_a_block_travels_once_for_many_partners(spark):
    names = [f"0-{i}" for i in range(64)]
    blocked = spark.createDataFrame([(n, [i], [1], [[1.0]]) for i, n in enumerate(names)], "block string, ids array<bigint>, ms array<bigint>, us array<array<double>>")
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a <= b], "block_a string, block_b string")
    rows = V._met_blocks(blocked, pairs).select("part", "salt", "block", "partners").collect()
    assert sorted((a, r["block"]) for r in rows for a in r["partners"] or []) == sorted(map(tuple, pairs.collect()))
    held = {(r["part"], r["salt"], r["block"]) for r in rows if r["partners"] is None}
    assert all((r["part"], r["salt"], a) in held for r in rows for a in r["partners"] or [])
    assert len(rows) < pairs.count() / 3
