"""The bootstrap's draws against hashlib, and its sums against plain Python."""

import hashlib

import numpy as np
import pytest

from spindle.operators import sample as SM
from spindle.operators.md5 import first_words


@pytest.mark.parametrize("head", [b"40:en:", b"40::", b"40:" + b"q" * 44 + b":", b"40:" + b"q" * 60 + b":"])
@pytest.mark.parametrize("tails", [[b""], [b":7", b":0"], [b":%07d" % i for i in range(40)]])
def test_first_words_equal_hashlib(head, tails):
    got = np.zeros((len(tails), 1100), np.uint32)
    for low, rows, words in first_words(head, tails, 1100):
        got[rows, low : low + words.shape[1]] = words
    assert got.tolist() == [[int(hashlib.md5(head + str(r).encode() + t).hexdigest()[:8], 16) for r in range(1100)] for t in tails]


def _weight(*parts):
    u = int(hashlib.md5(":".join(parts).encode()).hexdigest()[:8], 16) / 4294967296.0
    return sum(u >= c for c in SM.poisson_thresholds())


def test_sums_are_one_row_a_group_of_a_task(spark):
    rows = [("a", 1, 0.5), ("a", 22, None), ("a", None, 2.0), (None, 3, 1.0), ("a", -4, 0.25), ("é", 5, None)]
    df = spark.createDataFrame(rows, "g string, id long, x double")
    F = SM.F
    drawn = df.coalesce(1).select("g", F.concat_ws(":", F.lit("40"), F.coalesce("g", F.lit("")), F.lit("")).alias("_head"), F.col("id").cast("string").alias("_key"), F.col("x").alias("_x"))
    got = {r["g"]: r for r in SM.resample_sums(drawn, ["g"], 120).collect()}
    assert set(got) == {"a", None, "é"}
    for g, r in got.items():
        own = [(i, x) for k, i, x in rows if k == g]
        w = [[_weight("40", g or "", str(rep), *([] if i is None else [str(i)])) for i, _ in own] for rep in range(120)]
        assert r["w"] == [sum(ws) for ws in w]
        sums = [[k * x for k, (_, x) in zip(ws, own, strict=True) if x is not None] for ws in w]
        assert r["wx"] == [pytest.approx(sum(s)) if s else None for s in sums]
    ci = {r["g"]: (r["mean"], r["ci_lo"]) for r in SM.bootstrap_ci(df, "x", "id", ("g",), reps=120).collect()}
    assert ci["é"] == (None, None) and ci["a"][0] == pytest.approx(2.75 / 3)
