"""Tokens in texts: the automaton and the join for larger token tables against a plain search."""

import pytest
from pyspark.sql import functions as F

from spindle.operators import alerts as A
from spindle.operators import joins as J
from spindle.operators import matcher

LONG = "x" * 30 + "pneumonoultramicroscopic"
TEXTS = ["", None, "The cat's CAT scan; 12-34", f"a {LONG}s b", "catcat", "日本語の本 cat", "(cat) [Na+] [na+]", "é é É", "c-a-t " * 3000, "🙂🙂a", LONG[1:] + " " + LONG[:-1]]
TOKENS = ["cat", "c", "at", "", None, LONG, LONG + "s", "本", "12-34", "[na+]", "é", "🙂a", "absent", "cat scan", "é", "cat", "-a-t c-a-t c-a-t"]


@pytest.fixture(params=[J.MATCHER_CHARS, 0], ids=["automaton", "join"])
def path(request, monkeypatch):
    monkeypatch.setattr(J, "MATCHER_CHARS", request.param)
    return request.param


def _docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").withColumn("tokens_n", F.lit(1))


@pytest.mark.parametrize("lower", [True, False])
def test_both_ways_equal_a_plain_search(spark, path, lower):
    cands = spark.createDataFrame([(t,) for t in TOKENS], "token string")
    rows = J.containment_join(cands, _docs(spark), lower).select("token", "id").collect()
    want = {(t, i) for t in TOKENS if t is not None for i, x in enumerate(TEXTS) if x is not None and t in (x.lower() if lower else x)}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_letter_tokens(spark, path):
    tokens = ["cat", "at", LONG, "本", "é"]
    cands = spark.createDataFrame([(t,) for t in tokens], "token string")
    found = J.contained_tokens(cands, _docs(spark), letters_only=True)
    assert found.columns == ["id", "tokens_n", "tokens"]
    got = {r["id"]: sorted(r["tokens"]) for r in found.collect()}
    assert got == {i: sorted(t for t in tokens if x is not None and t in x.lower()) for i, x in enumerate(TEXTS)}


def test_no_tokens_no_texts(spark, path):
    none = spark.createDataFrame([], "token string")
    one = spark.createDataFrame([("cat",)], "token string")
    assert J.containment_join(none, _docs(spark)).collect() == []
    assert J.containment_join(one, _docs(spark).limit(0)).collect() == []
    assert {r["id"] for r in J.contained_tokens(none, _docs(spark)).collect()} == set(range(len(TEXTS)))


def test_finds_are_kept_for_a_bounded_number_of_parts(spark, monkeypatch):
    monkeypatch.setattr(matcher, "KEPT_PARTS", 2)
    cands = spark.createDataFrame([("1",), ("23",)], "token string")
    docs = spark.range(500).select("id", F.col("id").cast("string").alias("text"))
    got = {(r["token"], r["id"]) for r in J.containment_join(cands, docs).collect()}
    assert got == {(t, i) for t in ("1", "23") for i in range(500) if t in str(i)}


def test_alerts_shuffle_no_text(spark):
    rows = spark.range(200).select(
        "id", F.concat(F.lit("word cat "), F.col("id"), F.lit(" only"), F.col("id") % 7).alias("text"), (F.col("id") % 2).cast("int").alias("label")
    )
    plan = A.structural_alerts(rows)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert shuffles and all("hashpartitioning(token" in line for line in shuffles)
    found = {r["token"]: (r["tp"], r["fp"]) for r in A.alert_ppv(rows)[0].collect()}
    assert found["cat"] == (100, 100) and found["only"] == (100, 100)


def test_more_tokens_shuffle_no_pair(spark, monkeypatch):
    """Beyond MATCHER_CHARS rows meet their words' tokens in blocks: the same alerts, and no row's tokens are gathered by id."""
    rows = spark.range(300).select(
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("task"), "id",
        F.concat(F.lit("word Cat "), F.translate((F.col("id") % 50).cast("string"), "0123456789", "abcdefghij"), F.lit(" concat ")).alias("text"), F.lit("cat").alias("token"),
    ).select("*", F.when(F.col("task") == "a", F.col("id") % 2).otherwise(F.when(F.col("id") % 3 == 0, 0).otherwise(1)).cast("int").alias("label"))
    sides = []
    for chars in (J.MATCHER_CHARS, 0):
        monkeypatch.setattr(J, "MATCHER_CHARS", chars)
        monkeypatch.setattr(J, "BLOCK_WORDS", 200)
        found = J.contained_tokens(rows.select("token"), rows.select("id", "text").distinct(), letters_only=True)
        assert "collect_set(token" not in found._jdf.queryExecution().executedPlan().toString()
        scored, _ = A.alert_ppv(rows.drop("token"), group=("task",))
        sides.append((sorted(map(tuple, scored.collect())), sorted(map(tuple, A.alerts_per_task(rows.drop("token")).collect()))))
    assert sides[0] == sides[1]
    assert [(r["n_neg"], r["n_pos"]) for r in A.alerts_per_task(rows.drop("token")).orderBy("task").collect()] == [(150, 150), (100, 200)]
