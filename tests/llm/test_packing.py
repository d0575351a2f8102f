import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import edge_docs, edge_rows, no_docs, rows
from tokenizers import Tokenizer

from spindle.llm import packing
from spindle.llm.packing import Limits, Packer, Piece

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 4, 64), Limits(64, 64, 24), Limits(100, 3, 50), Limits(16, 1, 16)])
def test_limits_and_coverage(limits):
    rng = random.Random(limits.tokens)
    made: list[list[Piece]] = []
    p = Packer(limits, made.append)
    docs = []
    for d in range(400):
        n = rng.choice([1, 2, 5, rng.randrange(1, 40), rng.randrange(1, 400)])
        docs.append((n, rng.randrange(n + 1) if rng.random() < 0.5 else 0))
        p.add(Piece(d, np.arange(n), 0, docs[-1][1]))
        if len(p.pool) >= 50:
            p.run(25)
    p.run(0)
    seen = defaultdict(list)
    for seq in made:
        total = sum(x.tokens() for x in seq)
        assert 0 < total <= limits.tokens and len(seq) <= limits.segments
        assert sum(x.loss() for x in seq) <= limits.loss_tokens
        assert total == limits.tokens or total & (total - 1) == 0
        for x in seq:
            assert x.ids.tolist() == list(range(x.start, x.start + x.tokens()))
            seen[x.doc].append((x.start, x.tokens()))
    for d, (n, _) in enumerate(docs):
        at = 0
        for start, length in sorted(seen[d]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_dot_product_choice():
    """The first place goes to the piece with the largest demand along the free room, then to what still fits."""
    made = []
    p = Packer(Limits(16, 8, 16), made.append)
    for d, n in enumerate((3, 9, 7, 4)):
        p.add(Piece(d, np.arange(n), 0, 0))
    p.run(3)
    assert [x.doc for x in made[0]] == [1, 2]


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    got = rows(packing.pack(edge_docs(spark), PATH))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    ids = {r[0]: np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in edge_rows()}
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        assert sum(r["length"] for r in pieces) == len(ids[d]) * (2 if d == 1 else 1)  # row 1 is there twice
        for r in pieces:
            assert r["doc_tokens"] == len(ids[d])
            assert r["ids_crc32"] == zlib.crc32(ids[d][r["start"] : r["start"] + r["length"]].tobytes())
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack(no_docs(spark), PATH).collect() == []


def test_loss_column(spark):
    df = spark.createDataFrame([(i, "some words of a prompt and an answer " * 20, 60) for i in range(30)] + [(99, "x", None)], "doc_id long, text string, prompt int")
    got = rows(packing.pack(df, PATH, Limits(256, 8, 100), loss_from="prompt"))
    loss = defaultdict(int)
    for r in got:
        first = 0 if r["doc_id"] == 99 else 60
        loss[r["sequence_id"]] += max(0, r["start"] + r["length"] - max(r["start"], first))
    assert max(loss.values()) <= 100


def test_slow_path_gives_the_same_ids():
    fast = packing.Tokens(PATH)
    slow = packing.Tokens.__new__(packing.Tokens)
    slow.special, slow.fast, slow.slow = fast.special, None, Tokenizer.from_file(PATH)
    assert fast.slow is None
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", " ", "\n", "é", "日", "12", "!", "<|endoftext|>", "🙂", "'ll"]) for _ in range(40))
        assert fast.ids(text).tolist() == slow.ids(text).tolist()


def test_long_blank_runs(spark):
    """Runs of blanks that tiktoken gives up on, in texts longer than a piece: the ids of the tokenizers library."""
    library = Tokenizer.from_file(PATH)
    words = "some words, <|endoftext|> 12 of it's text 日本 " * 12_000
    texts = ["x" + " " * 2_000_000 + "y", "\n" * 1_500_000, words + " " * 1_200_000 + words, words]
    tokens = packing.Tokens(PATH)
    for t in texts:
        assert np.array_equal(tokens.ids(t), library.encode(t, add_special_tokens=False).ids)
    assert len(list(tokens._pieces(words))) > 2 and "".join(tokens._pieces(words)) == words
    got = rows(packing.pack(spark.createDataFrame(list(enumerate([*texts[:2], "plain"])), "doc_id long, text string"), PATH))
    for i, t in enumerate([*texts[:2], "plain"]):
        assert sum(r["length"] for r in got if r["doc_id"] == i) == len(library.encode(t, add_special_tokens=False).ids) + 1
