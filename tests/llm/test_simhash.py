import random

import numpy as np
import pytest
import xxhash
from helpers import edge_docs, edge_rows, no_docs, rows

from spindle.llm import simhash as S

BLANKS = " \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in BLANKS else c for c in low).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(data):
    """(doc_id, fingerprint, component) by all pairs."""
    fps = [plain_fingerprint(t) for _, t in data]
    parent = {d: d for d, _ in data if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(d, f) for (d, _), f in zip(data, fps) if d is not None]
    for i, (a, f) in enumerate(known):
        for b, g in known[:i]:
            if (f ^ g).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted([(d, f"{f:016x}", None if d is None else find(d)) for (d, _), f in zip(data, fps)], key=str)


def result(df):
    return sorted((tuple(r) for r in S.simhash_groups(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    centres = [[word() for _ in range(rng.choice([40, 300]))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = list(rng.choice(centres))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out + ["a b", "A  b", "", None, " \n", "a"]


def test_matches_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed, 150)
        data = [(i * 5 + 2, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
        assert result(df) == brute(data)


def test_ids_at_both_ends_of_long_and_in_several_classes(spark):
    texts = corpus(3, 40)
    ids = [-(2**63), 2**63 - 1, -(2**63) + 1, 2**63 - 2, 0, -1]
    data = [(ids[i % 6] if i < 12 else (i % 30) - 15, t) for i, t in enumerate(texts)]
    assert result(spark.createDataFrame(data, "doc_id long, text string")) == brute(data)


@pytest.mark.parametrize("bucket", [2, 64])
def test_crowded_buckets_lose_no_component(spark, monkeypatch, bucket):
    """Fingerprints around a few centres, more than a bucket takes: components equal those of all pairs."""
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = random.Random(bucket)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(120):
            f = centre
            for _ in range(rng.randrange(5)):
                f ^= 1 << rng.choice(range(0, 64, 4))
            fps.add(f)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    pairs = [(r["a"], r["b"]) for r in rows(S.close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")))]
    ok = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    assert pairs and all(ok(a, b) for a, b in pairs)

    def classes(edges):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(y for y in signed if find(y) == find(x)) for x in signed}

    assert classes(pairs) == classes([(a, b) for a in signed for b in signed if a < b and ok(a, b)])


def test_edge_rows(spark):
    assert result(edge_docs(spark)) == brute([(r[0], r[1]) for r in edge_rows()])
    assert S.simhash_groups(no_docs(spark)).collect() == []


def test_pieces_of_long_texts(monkeypatch):
    text = " ".join(f"w{i % 701}" for i in range(5000))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "PIECE", 64)
    assert S.fingerprint(text) == whole == plain_fingerprint(text)
