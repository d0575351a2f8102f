import itertools

import numpy as np
from helpers import edge_docs, edge_rows, no_docs, rows

from spindle.llm import crf


def brute(good, trans):
    n = len(good)
    weights = {}
    for y in itertools.product((0, 1), repeat=n):
        s = sum(g for g, v in zip(good, y, strict=True) if v) + sum(trans[a, b] for a, b in itertools.pairwise(y))
        weights[y] = np.exp(s)
    z = sum(weights.values())
    p = [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)]
    pairs = np.zeros((2, 2))
    for y, w in weights.items():
        for a, b in itertools.pairwise(y):
            pairs[a, b] += w / z
    return p, pairs, np.log(z)


def test_forward_backward():
    rng = np.random.default_rng(1)
    n_lines = np.array([3, 1, 6, 2])
    good, trans = rng.normal(size=12), rng.normal(size=(2, 2))
    p, pairs, z = crf.marginals(good, n_lines, trans, pairs=True)
    want = [brute(good[a : a + n], trans) for a, n in zip(np.cumsum(n_lines) - n_lines, n_lines, strict=True)]
    assert np.allclose(p, np.concatenate([w[0] for w in want]))
    assert np.allclose(pairs, sum(w[1] for w in want)) and np.isclose(z, sum(w[2] for w in want))


def test_line_features():
    texts = [b"one two\n\none two\nA A A", b"", b"\n", "é ñ\n#*$".encode()]
    x, chars, n_lines = crf.line_features(texts)
    assert n_lines.tolist() == [4, 1, 2, 2]
    assert chars.tolist() == [7, 0, 7, 5, 0, 0, 0, 3, 3]
    repeats, seen = crf.OWN - 1, crf.OWN  # places of the last two own features
    assert x[:, seen].tolist() == [0, 0, 1, 0, 0, 0, 0, 0, 0]
    assert np.isclose(x[3, repeats], np.sqrt(2 / 3)) and x[0, repeats] == 0
    assert np.allclose(x[1, 1 + crf.OWN : 1 + 2 * crf.OWN], x[0, 1 : 1 + crf.OWN])  # the line before
    assert not x[4, 1 + crf.OWN :].any()  # a text's only line has no neighbours
    alone = [crf.line_features([t])[0] for t in texts]
    assert np.allclose(np.concatenate(alone), x)  # texts don't touch each other


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"], k))
        lines = [words(rng.integers(4, 12)).capitalize() + "." for _ in range(rng.integers(1, 6))]
        bad = i % 4 == 0
        if bad:
            lines = [lines[0]] + [x.upper().replace(" ", "!! ") if i % 8 else x.replace(" ", "### ") for x in lines[1:] or lines]
        out.append((i, "\n".join(lines), int(not bad)))
    return out


def test_held_out_accuracy(spark):
    data = corpus(600, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(0, 0), (None, 1), (10_000, 1)], "doc_id long, quality int")
    theta = crf.train(docs, labels)
    got = {r["doc_id"]: r for r in rows(crf.scores(docs, theta))}
    import zlib

    held = [(i, q) for i, _, q in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i]["score"] >= crf.GOOD) == q for i, q in held]) > 0.95
    kept = {r["doc_id"] for r in rows(crf.good_documents(docs, theta))}
    assert kept == {i for i, r in got.items() if r["score"] >= crf.GOOD}


def test_edge_rows(spark):
    data = corpus(80, 4)
    theta = crf.train(
        spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string"), spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    )
    got = rows(crf.scores(edge_docs(spark), theta))
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    empty = [r["score"] for r in got if r["doc_id"] in (2, 3)]
    assert len(set(empty)) == 1  # null and empty texts score alike
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert set(crf.good_documents(edge_docs(spark), theta).columns) == set(edge_docs(spark).columns)
    assert crf.scores(no_docs(spark), theta).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert crf.train(docs, none) == [0.5]
    one = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    assert [r["score"] for r in rows(crf.scores(docs, crf.train(docs, one)))] == [1.0, 1.0]


def test_relabelled_lines():
    """The lines that fit a document's label best bear it; the others what the model says."""
    p = np.array([0.9, 0.8, 0.1, 0.2, 0.9, 0.7, 0.3])
    got = crf.relabelled(p, np.ones(7), np.array([4, 3]), np.array([0.0, 1.0]))
    assert got.tolist() == [1, 1, 0, 0, 1, 1, 0]
    # Where nothing fits, the label still holds for the best lines, by length.
    got = crf.relabelled(np.full(4, 0.9), np.array([1.0, 1.0, 1.0, 7.0]), np.array([4]), np.array([0.0]))
    assert got.tolist() == [0, 0, 0, 1]
    assert crf.relabelled(np.array([0.9]), np.ones(1), np.array([1]), np.array([0.0])).tolist() == [0]


def test_lines_of_mixed_documents(spark):
    """Labels of whole documents teach labels of lines: junk in good documents and clean lines in bad ones are told apart."""
    data = corpus(600, 5)
    theta = crf.fit([t.encode() for _, t, _ in data], np.array([q for *_, q in data], float))
    rng = np.random.default_rng(6)
    texts, truth = [], []
    for i in range(200):
        clean = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"], 8)).capitalize() + "." for _ in range(8)]
        junk = rng.random(8) < (0.2 if i % 2 else 0.7)
        texts.append("\n".join(x.replace(" ", "### ") if j and i % 4 < 2 else x.upper().replace(" ", "!! ") if j else x for x, j in zip(clean, junk, strict=True)))
        truth.append(junk)
    p, _, n_lines = crf.line_probabilities([t.encode() for t in texts], theta)
    bad, want = p < 0.5, np.concatenate(truth)
    assert (n_lines == 8).all()
    for flags, gold in ((bad, want), (~bad, ~want)):
        hits = (flags & gold).sum()
        assert 2 * hits / (flags.sum() + gold.sum()) >= 0.9
    scores, _, n_bad = crf.score([t.encode() for t in texts], theta)
    mixed = np.array([0 < j.sum() < 8 for j in truth])
    assert ((n_bad > 0) & (n_bad < 8))[mixed].mean() > 0.8
    # The share of good text follows the planted one; the score is a steep curve over it and keeps its order.
    weight = np.concatenate([[len(x) + 1 for x in t.split("\n")] for t in texts])
    share, planted = ((v * weight).reshape(-1, 8).sum(1) / weight.reshape(-1, 8).sum(1) for v in (p, ~want))
    assert np.corrcoef(share, planted)[0, 1] > 0.9
    assert (np.diff(scores[np.argsort(share)]) >= -1e-12).all()
