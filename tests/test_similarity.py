"""The banded Jaccard join: results against all pairs, and families of sets that share a template."""

import random

import pytest
from pyspark.sql import functions as F

from spindle.operators import joins as J

SCHEMA = "id long, token string"


def _brute(sets, threshold):
    rep = {}
    for i in sorted(sets):
        rep.setdefault(frozenset(sets[i]), i)
    reps = [(i, s) for s, i in rep.items() if s]
    return {(min(i, j), max(i, j)) for i, a in reps for j, b in reps if i < j and len(a & b) > threshold * len(a | b)}


@pytest.mark.parametrize("threshold", [0.125, 0.5, 0.75, 0.9375])
def test_equals_all_pairs(spark, threshold):
    rnd = random.Random(11)
    sets = {}
    for i in range(150):
        base = sets[rnd.randrange(i)] if i > 20 and rnd.random() < 0.7 else {f"w{rnd.randrange(60)}" for _ in range(rnd.randint(1, 60))}
        keep = {t for t in base if rnd.random() > 0.1}
        sets[i] = keep | {f"w{rnd.randrange(60)}" for _ in range(rnd.randint(0, 3))}
    shift = {i: (i * 7919 % 150) * 10**16 - 7 * 10**17 for i in sets}  # ids in no order, negative ones too
    sets = {shift[i]: s for i, s in sets.items()}
    df = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], SCHEMA)
    pairs, _ = J.similarity_self_join(df, threshold)
    rows = pairs.collect()
    got = {(r["id_a"], r["id_b"]): (r["n_common"], r["n_union"]) for r in rows}
    want = _brute(sets, threshold)
    assert len(got) == len(rows) and set(got) == want and len(want) > 3
    assert all(c == (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for (a, b), c in got.items())


def _family(spark, n, shared, own):
    """``n`` sets of ``shared`` tokens each plus ``own`` (and up to two more) of their own."""
    template = F.array(*[F.lit(f"t{k}") for k in range(shared)])
    mine = F.transform(F.sequence(F.lit(1), F.lit(own) + F.col("id") % 3), lambda k: F.concat(F.lit("o"), F.col("id"), F.lit("_"), k))
    return spark.range(n).select("id", F.explode(F.concat(template, mine)).alias("token"))


def test_a_family_below_the_threshold_gives_no_candidates(spark):
    reps, _ = J.collapse_identical_sets(_family(spark, 20_000, 30, 12))
    assert J.similarity_candidates(reps, 3, 5).count() == 0  # 30 / 54 shared, 200 million pairs


def test_a_family_around_the_threshold(spark):
    sets = {}
    for r in _family(spark, 60, 30, 9).collect():
        sets.setdefault(r["id"], set()).add(r["token"])
    pairs, _ = J.similarity_self_join(_family(spark, 60, 30, 9), 0.6)
    got = {(r["id_a"], r["id_b"]) for r in pairs.collect()}
    assert got == _brute(sets, 0.6) and 0 < len(got) < 60 * 59 // 2


def test_empty_and_single_sets(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    assert J.similarity_self_join(df, 0.6)[0].collect() == []
    assert J.similarity_self_join(df.limit(0), 0.6)[0].collect() == []
    with pytest.raises(ValueError):
        J.similarity_self_join(df, 0.0)


def test_sets_as_arrays_equal_sets_as_rows(spark):
    rows = [(1, ["b", "a", "b"]), (2, ["a"]), (2, ["b"]), (3, []), (4, None), (5, ["c"]), (None, ["c"])]
    arrays = spark.createDataFrame(rows, "id long, tokens array<string>")
    for df, copies in ((arrays, {1: 2, 5: 2}), (arrays.where("id <> 2"), {1: 1, 5: 1})):
        long = df.select("id", F.explode("tokens").alias("token")).distinct()
        got, want = ([sorted(map(str, part.collect())) for part in J.collapse_identical_sets(x)] for x in (df, long))
        assert got == want and sorted(map(str, J.similarity_members(df).collect())) == sorted(map(str, J.similarity_members(long).collect()))
        assert {r["id"]: r["m"] for r in J.collapse_identical_sets(df)[1].collect()} == copies


def test_counting_copies_shuffles_signatures_only(spark):
    rows = spark.createDataFrame([(i, [f"w{i % 7}", "x"]) for i in range(50)], "id long, tokens array<string>")
    plan = J.collapse_identical_sets(rows)[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def _random_sets(n, size, vocabulary, seed=5):
    rnd = random.Random(seed)
    return {i: {f"w{x}" for x in rnd.sample(range(vocabulary), rnd.randint(size - 10, size))} for i in range(n)}


def test_sets_that_share_rare_tokens_only_stay_in_their_task(spark):
    sets = _random_sets(300, 80, 400)  # about a ninth of two sets is shared, and nearly all meet on some first token
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tokens array<string>")
    assert J.similarity_candidates(J.collapse_identical_sets(df)[0], 3, 5).count() < 10


@pytest.mark.parametrize("threshold", [0.25, 0.6])
def test_several_blocks_equal_all_pairs(spark, monkeypatch, threshold):
    from spindle.operators import setpairs

    monkeypatch.setattr(setpairs, "BLOCK_BYTES", 3_000)
    rnd = random.Random(2)
    sets = _random_sets(60, 40, 200) | {i + 60: s for i, s in _random_sets(30, 15, 60).items()}
    for i in range(90, 180):
        base = sorted(sets[rnd.randrange(i)])
        sets[i] = set(rnd.sample(base, max(1, len(base) - rnd.randint(0, 6)))) | {f"n{i}"}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tokens array<string>")
    assert len({r["n"] for r in J.collapse_identical_sets(df)[0].collect()}) > 5
    got = {(r["id_a"], r["id_b"]): (r["n_common"], r["n_union"]) for r in J.similarity_self_join(df, threshold)[0].collect()}
    assert set(got) == _brute(sets, threshold) and len(got) > 30
    assert all(c == (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for (a, b), c in got.items())


def test_only_rows_of_pairs_and_of_repeated_sets_are_explained(spark):
    from spindle.operators import quality as Q

    members = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 6)], "id long, rep long")
    pairs = spark.createDataFrame([(1, 5)], "id_a long, id_b long")
    assert sorted(r["id"] for r in Q.rows_in_pairs(pairs, members).collect()) == [1, 3, 4, 5]
