"""Operators on whole rows of tokens against plain versions; their plans shuffle no token rows."""

import hashlib
import io
from collections import Counter
from contextlib import redirect_stdout

import numpy as np

from spindle.functions import text as T
from spindle.operators import rowwise as RW
from spindle.operators import sample as SM


def _md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def _plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


TEXTS = [(1, "a b c d e f g h i j k"), (2, "x"), (3, "1 2 b"), (3, "q r s t u v"), (4, ""), (5, None), (None, "m n o p")]


def _texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def _positions():
    """(pos, token) of every id that has tokens; rows that share an id are one."""
    got = {}
    for i, t in TEXTS:
        for p, w in enumerate((t or "").split()):
            got.setdefault(i, []).append((p, w))
    return {i: sorted(v) for i, v in got.items()}


def test_keep_fraction_shuffles_no_tokens(spark):
    rows = RW.token_rows(_texts(spark), ["id"], tokens=T.text_tokens, pattern=T.TEXT_TOKEN_PATTERN)
    df = SM.perturb_keep_fraction(rows, reps=3, frac=0.9, seed=42)
    assert "explode" not in _plan(df) and "Window" not in _plan(df)
    got = {(r["id"], r["rep"]): r["tokens"] for r in df.collect()}
    want = {}
    for i, v in _positions().items():
        for rep in range(3):
            name = [x for x in (42, i, rep) if x is not None]
            order = sorted(v, key=lambda x: (_md5(*name, x[0]), x[0]))
            want[i, rep] = sorted(order[: max(1, int(len(v) * 0.9))])
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for k, v in want.items():
        if k[0] != 3:  # which of two tokens of one place stays is open
            assert got[k] == [w for _, w in v]
    long = spark.createDataFrame([(1, p, w) for p, w in _positions()[1]], "id long, pos int, token string")
    assert SM.perturb_keep_fraction(long).orderBy("rep").first()["tokens"] == got[1, 0]


def test_replace_token_shuffles_no_tokens(spark):
    rows = RW.token_rows(_texts(spark), ["id"], tokens=T.text_tokens, pattern=T.TEXT_TOKEN_PATTERN)
    df = SM.perturb_replace_token(rows, seed=42)
    assert "explode" not in _plan(df) and "Join" not in _plan(df)
    got = {r["id"]: r for r in df.collect()}
    assert set(got) == {1, 2, 3}
    for i, v in _positions().items():
        if i in (1, 2):
            target = min(v, key=lambda x: _md5(42, i, x[0]))[1]
            other = min({w for _, w in v} - {target}, key=lambda w: _md5(42, i, w), default=None)
            assert (got[i]["target"], got[i]["replacement"]) == (target, other)
            assert got[i]["tokens"] == [other if w == target and other else w for _, w in v]
    assert Counter(got[3]["tokens"])[got[3]["replacement"]] == 2 and len(got[3]["tokens"]) == 9


def test_explanations_shuffle_no_positions(spark):
    """Measures of rows with repeated ids and tokens, against a plain version; no window or sort of token rows."""
    from pyspark.sql import functions as F

    from spindle.operators import quality as Q

    texts = [(1, "a b a c"), (2, "c d"), (2, "e e a"), (3, "b")]
    weights = {"a": 1.0, "b": -2.0, "c": 0.5, "d": 3.0}
    df = spark.createDataFrame(texts, "id long, text string")
    w = spark.createDataFrame(list(weights.items()), "token string, w double")
    tw = RW.weighted_rows(RW.with_words(RW.token_rows(df, ["id"]), ["id"]), ["id"], w)
    m = Q.row_measures(tw, ["id"], F.lit(0.1), ("removed",))
    assert "Window" not in _plan(m)
    got = {(r["method"], r["id"]): (r["total"], r["removed"]) for r in m.collect()}
    rows = {}
    for i, t in texts:
        rows.setdefault(i, []).extend(enumerate(t.split()))
    assert len(got) == 4 * len(rows)
    for i, r in rows.items():
        r = sorted(r)
        of = [weights.get(t, 0.0) for _, t in r]
        count = Counter(t for _, t in r)
        for method, score in (("ig", of), ("occlusion", [x * count[t] for x, (_, t) in zip(of, r)])):
            order = sorted(range(len(r)), key=lambda j: (-score[j], r[j][0]))[: max(1, int(len(r) * 0.4))]
            top = {r[j][1] for j in order}
            want = (sum(of), sum(x for x, (_, t) in zip(of, r) if t in top))
            assert all(abs(a - b) < 1e-9 for a, b in zip(got[method, i], want)), (method, i)


def test_perturbed_copies_equal_kept_tokens(spark):
    """The measured copies of a row are those that ``perturb_keep_fraction`` gives; the counts of all copies add up."""
    rows = RW.token_rows(_texts(spark), ["id"], tokens=T.text_tokens, pattern=T.TEXT_TOKEN_PATTERN)
    copies = {(r["id"], r["rep"]): r["tokens"] for r in SM.perturb_keep_fraction(rows, reps=2).collect()}
    for r in SM.perturbed_rows(rows, reps=2).collect():
        total = Counter(r["tokens"])
        for rep in range(2):
            gone = set(r["dropped"][r["cuts"][rep] : r["cuts"][rep + 1]])
            left = [t for i, t in enumerate(r["tokens"]) if i not in gone]
            assert left == copies[r["id"], rep]
            total.update(left)
        assert dict(zip(r["words"], r["n_all"])) == total and dict(zip(r["words"], r["n"])) == Counter(r["tokens"])


def test_bigram_model_reads_the_texts_once(spark):
    from spindle.operators import model as MD

    train = spark.createDataFrame([(1, "a b a"), (2, "a b")], "id long, text string")
    scored = MD.score_bigrams(spark.createDataFrame([(9, "a b z")], "id long, text string"), train, "id")
    assert "LocalTableScan" in _plan(scored) or "Scan ExistingRDD" in _plan(scored)
    plan = _plan(scored)
    assert plan.count("posexplode") + plan.count("Generate") <= 2  # of the held-out text only
    got = [round(r["logp"], 9) for r in scored.orderBy("pos").collect()]
    # V = a, b, </s> and <unk>
    import math

    want = [math.log(2.5 / 4), math.log(2.5 / 5), math.log(0.5 / 4), -math.log(4)]
    assert got == [round(x, 9) for x in want]


def test_numbered_keys_equal_hashlib():
    from spindle.operators.md5 import numbered

    heads = [b"", b"42:7:", b"42:11:", b"x" * 52, b"y" * 70, "ü:".encode()]
    numbers = [np.array(x) for x in ([0], [3, 10, 999, 3], range(1200), [5, 100], [7], [])]
    for wide, size in ((False, 4), (True, 8)):
        got = numbered(heads, numbers, wide)
        want = [[int.from_bytes(hashlib.md5(h + str(i).encode()).digest()[:size], "big") for i in x] for h, x in zip(heads, numbers, strict=True)]
        assert [x.tolist() for x in got] == want


def test_rows_draw_together_without_a_call_per_position(monkeypatch):
    from types import SimpleNamespace

    from spindle.operators import md5

    pos = [np.arange(30), np.array([0, 0, 1, 2])]
    want = []
    for parts, p in zip(("1", "a:2"), pos, strict=True):
        key = lambda rep, x, parts=parts: hashlib.md5(f"42:{parts}:{rep}:{x}".encode()).digest()
        want.append([sorted(sorted(range(len(p)), key=lambda i: (key(rep, p[i]), p[i], i))[: max(1, int(0.9 * len(p)))]) for rep in range(3)])
    got = RW.kept_in_copies([["1"], ["a", "2"]], 3, pos, 0.9, 42)
    assert [[k.tolist() for k in row] for row in got] == want

    def none(*_):
        raise AssertionError("one position at a time")

    monkeypatch.setattr(md5, "hashlib", SimpleNamespace(md5=none))
    monkeypatch.setattr(RW, "hashlib", SimpleNamespace(md5=none), raising=False)
    assert RW.kept_in_copies([["1"]], 3, pos[:1], 0.9, 42)[0][2].tolist() == want[0][2]
    draws = RW.Draws(40, 42)
    assert [draws.add(["1"], pos[0]), draws.add(["2", "1"], pos[0][:5])] == [0, 1] and draws.bits(1, 0).shape == (5, 40)
