import random

import public_tokenizers
import pytest
from helpers import edge_docs, edge_rows, no_docs
from tokenizers import Tokenizer

from spindle.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def random_texts(n, seed):
    rng = random.Random(seed)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "1", "23", "!", "'s", "'", "é", "ß", "日", "🙂", "\u0085", "\x1c", "՘", "\U0002ceab", "<|endoftext|>", "<|", "\t", "​"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_equal_the_librarys():
    c = bpe.Codec(PATH)
    texts = random_texts(600, 1) + ["", None, "a" * 700, "é" * 400, " " * 300, "<|endoftext|>" * 3]
    for text, ids in zip(texts, c.encode(texts), strict=True):
        assert ids.tolist() == library(text), text
        assert c.decode(ids.tolist()) == LIBRARY.decode(library(text), skip_special_tokens=False) == (text or "")


def test_lanes_and_single_trees_agree():
    c = bpe.Codec(PATH)
    rng = random.Random(2)
    words = {"".join(rng.choice("abcdeéñtionh ") for _ in range(rng.randrange(1, 40))) for _ in range(800)}
    c.learn(words)
    for w in words:
        assert c.cache[w] == c._single(w.encode())


def test_pieces_and_full_caches_change_nothing(monkeypatch):
    texts = random_texts(80, 3) + ["word and word " * 300]
    plain = [x.tolist() for x in bpe.Codec(PATH).encode(texts)]
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    monkeypatch.setattr(bpe, "CACHE", 20)
    assert [x.tolist() for x in bpe.Codec(PATH).encode(texts)] == plain


def test_decode_of_broken_ids():
    c = bpe.Codec(PATH)
    for ids in ([187], [50256, 0], [94, 187, 11], [255, 254]):
        assert c.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_edge_rows(spark):
    got = [tuple(r) for r in bpe.encode(edge_docs(spark), PATH).collect()]
    want = [(r[0], library(r[1])) for r in edge_rows()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    back = bpe.decode(bpe.encode(edge_docs(spark), PATH), PATH)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((r[0], r[1] or "")) for r in edge_rows())
    assert bpe.digest(no_docs(spark), PATH).collect() == []


def test_other_kinds_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
