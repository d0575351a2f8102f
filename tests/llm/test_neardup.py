import random
from itertools import combinations

import numpy as np
from helpers import edge_docs, edge_rows, no_docs, rows

from spindle.llm import neardup as N
from spindle.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(data):
    sets = [(d, shingles(t)) for d, t in data]
    parent = {d: d for d, _ in data if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and a is not None and b is not None and 100 * len(s & t) >= 75 * len(s | t):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    out = []
    for d, s in sets:
        c = (find(d) if s else d) if d is not None else None
        out.append((d, len(s), c, None if d is None else d == c))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in N.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def groups(seed):
    """Exact copies, a large group of near copies around one text, chains, heavily edited copies, a shared passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    centre = [word() for _ in range(60)]
    for i in range(120):
        w = list(centre)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            w[rng.randrange(60)] = word()
        texts.append(" ".join(w))
    texts += [" ".join(centre)] * 25
    chain = [word() for _ in range(90)]
    for i in range(12):
        texts.append(" ".join(chain[i * 3 : i * 3 + 55]))
    passage = " ".join(word() for _ in range(30))
    texts += [f"{' '.join(word() for _ in range(rng.randrange(2, 40)))} {passage}" for _ in range(60)]
    texts += [passage, "a b c", "A b  c", "a b", "", None, "  "]
    rng.shuffle(texts)
    return [(i * 7 + 3, t) for i, t in enumerate(texts)]


def test_matches_brute_force(spark):
    for seed in (1, 2):
        data = groups(seed)
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
        assert result(df) == brute(data)


def test_threshold_is_exact(spark):
    """16 shingles of which 14 are shared in each of two sets of 16: 14 / 18 links; 13 / 19 doesn't."""
    w = [f"w{i}" for i in range(20)]
    data = [(1, " ".join(w)), (2, " ".join([*w[:18], "x", "y"])), (3, " ".join([*w[:17], "p", "q", "r"]))]
    assert result(spark.createDataFrame(data, "doc_id long, text string")) == brute(data)
    assert brute(data)[1][2] == 1


def test_edge_rows(spark):
    assert result(edge_docs(spark)) == brute([(r[0], r[1]) for r in edge_rows()])
    assert N.near_duplicates(no_docs(spark)).collect() == []


def test_windows_of_long_texts(monkeypatch):
    text = " ".join(f"w{i % 5000}" for i in range(70_000))
    whole = N.shingle_set(text)
    assert len(whole) == len(shingles(text))
    monkeypatch.setattr(N, "PIECE", 1 << 12)
    assert (N.shingle_set(text) == whole).all()


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    for j in (0.2, 0.5, 0.75, 0.9):
        n = 4000
        both = int(2 * n * j / (1 + j))
        got = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = x[:n], x[n - both :]
            s, t = N.sketch(a), N.sketch(b)
            assert (N.merged(s, t) == N.sketch(x)).all()
            got.append(N.estimate(s[None], t[None], np.array([n]), np.array([n]))[0])
        assert abs(np.mean(got) - j) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200, 100), (100, 200), (300, 300), (7, 201), (201, 100)]
    got = {r["node"]: r["component"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {i: 0 for i in [*range(1, 51), 100, 200, 201]}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ids_at_both_ends_of_long(spark):
    """Ids whose sums would overflow, negative ones too."""
    texts = [t for _, t in groups(4)][:90]
    ids = [2**63 - 1 - i for i in range(45)] + [-(2**63) + i for i in range(45)]
    data = list(zip(ids, texts))
    assert result(spark.createDataFrame(data, "doc_id long, text string")) == brute(data)


def test_ids_in_several_classes(spark):
    """A repeated id joins the classes of all its texts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    data = [(5, a), (9, a), (9, c), (11, c), (20, b), (21, b), (21, c), (30, "a b")]
    got = result(spark.createDataFrame(data, "doc_id long, text string"))
    assert got == brute(data)
    assert {r[0]: r[2] for r in got} == {5: 5, 9: 5, 11: 5, 20: 5, 21: 5, 30: 30}


def test_template_families_dont_pair(spark):
    """Documents of one template below the threshold: no pair is made of two that can't link, and links stay."""
    rng = random.Random(6)
    template = [f"t{i}" for i in range(160)]
    data = [(i, " ".join(template + [f"own{i}x{k}" for k in range(36)])) for i in range(120)]
    data += [(500 + i, " ".join(template[: 120 + i])) for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert result(df) == brute(data)
    left = spark.createDataFrame([(i, i, len(shingles(t)), N.fingerprint(N.shingle_set(t))) for i, t in data[:120]], "rep long, component long, n long, fp binary")
    assert N._exact_pairs(left, df).count() == 0


def test_the_keys_of_the_bands_are_never_broadcast(spark, monkeypatch):
    """Their size is estimated from the classes' width: 40 keys each count as less than the class itself."""
    plans = {}

    def spied(df, name, done=N.written):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return done(df, name)

    monkeypatch.setattr(N, "written", spied)
    N.near_duplicates(spark.createDataFrame([(i, f"a b c d e f g h{i % 3}") for i in range(9)], "doc_id long, text string")).count()
    for name in ("neardup-buckets", "neardup-prefix"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name]
