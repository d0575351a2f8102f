import hashlib
import random
import zlib

import pytest
from helpers import CLASH, rows
from pyspark.sql import functions as F

from spindle.llm import trie as R

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(data):
    own = {}
    for r in data:
        if r[0] is not None:
            own.setdefault(r[0], []).append(r)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(t, key=key)] for c, t in own.items()}
    trunc = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(trunc(c), [])[:h] + t[h:]
    return out


def brute(data):
    seqs = rebuilt(data)
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n] for n in members}

    def below(n):
        leaves, saved = int(not kids[n]), (len(members[n]) - 1) * (len(n[-1][1]) if n else 0)
        for k in kids[n]:
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for n, m in members.items():
        ends = sorted(c for c in m if len(seqs[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), *below(n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, shard_rows=R.SHARD_ROWS):
    return sorted((tuple(r) for r in R.prefix_trie(R.rebuilt(df), shard_rows).select(*COLUMNS).collect()), key=str)


def chats(seed, n):
    """A popular first turn, a large group of equal conversations, chains, negative ids."""
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-150, 700), n):
        kind = rng.random()
        turns = rng.randrange(1, 9)
        texts = [f"same {i}" for i in range(6)] if kind < 0.3 else [rng.choice("ab") * rng.randrange(1, 3) for _ in range(turns)]
        if kind > 0.8:
            texts[0] = "hello"
        out += [(c, i if rng.random() < 0.95 else None, "user" if i % 2 == 0 else "assistant", t if rng.random() < 0.97 else None) for i, t in enumerate(texts)]
    return out


@pytest.mark.parametrize("shard_rows", [0, 3, 40, 100_000])
def test_matches_brute_force(spark, shard_rows):
    """The same trie whether all nodes are upper ones, some or none."""
    data = chats(shard_rows, 150)
    assert result(spark.createDataFrame(data, SCHEMA).repartition(4), shard_rows) == brute(data)


def test_edge_rows(spark):
    data = [
        (0, 1, "user", "hi"), (0, 1, "user", "hi"), (0, None, None, None), (1, 0, "user", None), (1, 0, None, ""), (101, 5, "x", "y" * 50_000),
        (None, 0, "user", "lost"), (-5, 2, "user", "🙂🙂"), (2**63 - 1, 0, "u", "t"), (-(2**63), 0, "u", "t"),
    ]
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})
    assert result(df) == brute(data) == result(df, 1)
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_long_conversation(spark):
    data = [(7, i, "user", f"t{i // 2}") for i in range(2000)] + [(8, i, "user", f"t{i // 2}") for i in range(1500)]
    got = result(spark.createDataFrame(data, SCHEMA).repartition(3))
    depth = {c: len(s) for c, s in rebuilt(data).items()}
    assert max(r[1] for r in got) == max(depth.values())


def test_double_array():
    rng = random.Random(4)
    paths = list({tuple(rng.randrange(1, 30) for _ in range(rng.randrange(6))) for _ in range(300)})
    trie = R.packed([list(p) for p in paths])
    seen = {(): 1}
    for p in paths:
        state = 1
        for i, x in enumerate(p):
            state = trie.step(state, x)
            assert state
            assert seen.setdefault(p[: i + 1], state) == state
    assert len(set(seen.values())) == len(seen)
    for p, state in seen.items():
        for x in range(1, 32):
            assert (trie.step(state, x) != 0) == ((*p, x) in seen)


def test_ends_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE_IDS", 7)
    ids = list(range(-50, 60))
    df = spark.createDataFrame([(b"n" if i % 3 else b"m", i) for i in ids], "node binary, conv_id long").repartition(5)
    got = {bytes(r["node"]): r["ends_sha256"] for r in rows(R._ends(df))}
    assert got == {k: R.digest([i for i in ids if (i % 3 != 0) == (k == b"n")]) for k in (b"n", b"m")}
