"""Operator 6, byte-level BPE encoding and decoding with a segment tree.

A word starts as one symbol per byte.  The leaves of a segment tree hold, for
each symbol, the rank of the pair it forms with its right neighbour; every
inner node holds the smaller of its children as (rank, place).  The root is
thus the leftmost pair of the lowest rank.  A merge changes three leaves (the
pair, its left neighbour, the vanished symbol), each a logarithmic update, and
the word is done when no mergeable pair remains.

Words of up to ``LANES`` bytes are encoded many at a time: one tree per row of
a numpy matrix, all rows doing their next merge in the same step.  Longer
words have a tree of their own.  A worker remembers words in a cache of
bounded size, which is only a matter of speed.

Texts are cut into words by the byte-level pre-tokenizer's pattern after
special tokens have been split off.  Texts are worked on in pieces of bounded
size, cut only before a lone space between two other characters, where no
word can cross.

Defined results
* null or empty text: no ids, decoded as the empty string; null ids: null
* repeated rows: each its own result; other columns are ignored
* empty table: no rows
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import arrow_schema, read_table, slices

#: The pre-tokenizer's pattern (fixed value of byte-level BPE vocabularies).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words that are encoded in lanes; words a worker remembers; characters and bytes worked on at a time.
LANES, CACHE, PIECE_CHARS, SLICE_BYTES = 64, 300_000, 1 << 20, 2 << 20


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in a byte-level vocabulary: printable bytes stand for themselves, the others for U+0100 upwards."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _without_newer(path: str) -> tuple[re.Pattern | None, regex.Pattern]:
    """Letters and digits that the regex library knows but the file's pre-tokenizer (an older Unicode version) doesn't,
    and the pattern without them.  Only characters unknown to this Python's Unicode tables need asking."""
    from tokenizers import Tokenizer

    ask = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    known = regex.compile(r"[\p{L}\p{N}]")
    doubtful = [c for c in map(chr, range(0x110000)) if category(c) == "Cn" and known.match(c)]
    codes = [ord(c) for c in doubtful if len(ask(("a" if regex.match(r"\p{L}", c) else "1") + c)) > 1]
    if not codes:
        return None, regex.compile(PATTERN)
    starts = sorted(set(codes) - {c + 1 for c in codes})
    stops = sorted(set(codes) - {c - 1 for c in codes})
    newer = "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, stops, strict=True))
    older = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{newer}])")
    older = older.replace(r" ?\p{L}+", f" ?(?:(?![{newer}])\\p{{L}})+").replace(r" ?\p{N}+", f" ?(?:(?![{newer}])\\p{{N}})+")
    return re.compile(f"[{newer}]"), regex.compile(older)


class Codec:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        vocab, alphabet = model["vocab"], byte_alphabet()
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.token = [b""] * self.size
        for s, i in vocab.items():
            self.token[i] = bytes(alphabet[c] for c in s) if all(c in alphabet for c in s) else s.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.decimal = [str(i) for i in range(self.size)]
        self.byte_id = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = left * self.size + right
        self.rank_of = dict(zip(key.tolist(), range(len(key)), strict=True))
        self.n_ranks = len(key)
        self._fill_slots(key)
        self.words = regex.compile(PATTERN)
        self.newer, self.words_older = _without_newer(path)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.safe_cut = regex.compile(r"(?<=\S) (?=\S)")
        self.cache: dict[str, bytes] = {}

    # -- words -------------------------------------------------------------

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill_slots(self, key: np.ndarray) -> None:
        """Open-addressing table of all pairs, at most a sixteenth full."""
        self.bits = max(4, (16 * len(key)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, self.n_ranks, np.int32)
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.slot_key[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = free[first]
            self.slot_key[at[won]] = key[todo[won]]
            self.slot_rank[at[won]] = todo[won]
            todo, at = todo[~won], at[~won] + 1 & len(self.slot_key) - 1

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; ``n_ranks`` where it doesn't merge."""
        key = a.astype(np.int64) * self.size + b
        at = self._slot(key)
        found = self.slot_key[at]
        rank = self.slot_rank[at]
        miss = np.flatnonzero((found != key) & (found >= 0))
        rank[found != key] = self.n_ranks
        at = at[miss]
        while len(miss):
            at = at + 1 & len(self.slot_key) - 1
            found = self.slot_key[at]
            hit = found == key[miss]
            rank[miss[hit]] = self.slot_rank[at[hit]]
            go = ~hit & (found >= 0)
            miss, at = miss[go], at[go]
        return rank

    def _lanes(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids (as bytes of uint32) of words of at most ``width`` bytes, a power of two."""
        n, place = len(words), np.arange(width, dtype=np.int32)
        lens = np.fromiter(map(len, words), np.int32, n)
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        none = self.n_ranks * width + width  # above every rank * width + place
        sym = np.zeros((n, width + 1), np.int32)
        sym[:, :width] = self.byte_id[raw]
        after = np.empty((n, width + 1), np.int32)  # width: no symbol
        after[:] = np.append(place + 1, width)
        after[np.arange(n), lens - 1] = width
        before = np.empty((n, width + 1), np.int32)  # -1: no symbol
        before[:] = np.append(place - 1, -1)
        tree = np.full((n, 2 * width), none, np.int32 if none < 1 << 31 else np.int64)
        row, at = np.nonzero(place[None, :-1] < lens[:, None] - 1)
        rank = self._ranks(sym[row, at], sym[row, at + 1])
        tree[row, width + at] = np.where(rank < self.n_ranks, rank.astype(tree.dtype) * width + at, none)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        gone = place[None, :] >= lens[:, None]
        flat_tree, flat_sym, flat_after, flat_before = tree.ravel(), sym.ravel(), after.ravel(), before.ravel()

        def update(r: np.ndarray, leaf: np.ndarray, value) -> None:
            base, node = r * (2 * width), leaf + width
            flat_tree[base + node] = value
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                child = base + 2 * node
                flat_tree[base + node] = np.minimum(flat_tree[child], flat_tree[child + 1])

        def pair_at(r: np.ndarray, leaf: np.ndarray) -> np.ndarray:
            base = r * (width + 1)
            right = flat_after[base + leaf]
            rank = self._ranks(flat_sym[base + leaf], flat_sym[base + right])
            return np.where((right < width) & (rank < self.n_ranks), rank.astype(tree.dtype) * width + leaf, none)

        rows = np.flatnonzero(tree[:, 1] < none)
        while len(rows):
            rank, leaf = np.divmod(tree[rows, 1], width)
            base = rows * (width + 1)
            lost = flat_after[base + leaf]
            flat_sym[base + leaf] = self.made[rank]
            nxt = flat_after[base + lost]
            flat_after[base + leaf] = nxt
            flat_before[base + nxt] = leaf
            gone[rows, lost] = True
            update(rows, lost, none)
            update(rows, leaf, pair_at(rows, leaf))
            left = flat_before[base + leaf]
            has = left >= 0
            if has.any():
                update(rows[has], left[has], pair_at(rows[has], left[has]))
            rows = rows[tree[rows, 1] < none]
        flat, ends = sym[:, :width][~gone].astype(np.uint32).tobytes(), np.cumsum((~gone).sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _single(self, word: bytes) -> bytes:
        """Ids of one word of any length, by a tree of its own."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        sym = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        none = (self.n_ranks, width)
        rank_of, size, made = self.rank_of, self.size, self.made
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = rank_of.get(sym[i] * size + sym[i + 1])
            if r is not None:
                tree[width + i] = (r, i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(at: int) -> None:
            right = after[at] if sym[at] >= 0 else -1
            r = rank_of.get(sym[at] * size + sym[right]) if right >= 0 else None
            node = width + at
            tree[node] = none if r is None else (r, at)
            while node := node >> 1:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] != none:
            rank, at = tree[1]
            lost = after[at]
            sym[at], sym[lost], after[at] = int(made[rank]), -1, after[lost]
            if after[at] >= 0:
                before[after[at]] = at
            update(lost)
            update(at)
            if before[at] >= 0:
                update(before[at])
        return np.array([s for s in sym if s >= 0], np.uint32).tobytes()

    def learn(self, words: set[str]) -> None:
        """Put those words into the cache that it lacks."""
        cache = self.cache
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for w in words.difference(cache):
            raw = w.encode()
            if len(raw) > LANES:
                cache[w] = self._single(raw)
            else:
                groups.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for width, group in groups.items():
            for lo in range(0, len(group), 1 << 14):
                part = group[lo : lo + (1 << 14)]
                cache.update(zip((w for w, _ in part), self._lanes([r for _, r in part], width), strict=True))

    # -- texts -------------------------------------------------------------

    def _words(self, piece: str) -> list[str]:
        if self.newer and not piece.isascii() and self.newer.search(piece):
            return self.words_older.findall(piece)
        return self.words.findall(piece)

    def _pieces(self, text: str) -> Iterator[str]:
        """The text in pieces that words don't cross."""
        at = 0
        while len(text) - at > PIECE_CHARS:
            cut = self.safe_cut.search(text, at + PIECE_CHARS)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[list[bytes]] = []  # by text: the ids of its parts
        todo: list[tuple[list[bytes], int, list[str]]] = []  # words whose ids go to that place
        size = 0

        def flush() -> None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            new: set[str] = set()
            for _, _, words in todo:
                new.update(words)
            self.learn(new)
            get = self.cache.__getitem__
            for parts, at, words in todo:
                parts[at] = b"".join(map(get, words))
            todo.clear()

        for text in texts:
            parts: list[bytes] = []
            out.append(parts)
            for part in self.split.split(text or "") if self.split else [text or ""]:
                if part in self.special:
                    parts.append(np.uint32(self.special[part]).tobytes())
                    continue
                for piece in self._pieces(part):
                    todo.append((parts, len(parts), self._words(piece)))
                    parts.append(b"")
                    size += len(piece)
                    if size > PIECE_CHARS:
                        flush()
                        size = 0
        flush()
        return [np.frombuffer(b"".join(parts), np.uint32) for parts in out]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; special tokens are kept."""
        token = self.token
        return b"".join([token[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
TEXTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
DIGESTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row's text."""
    schema = arrow_schema(IDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, "text", SLICE_BYTES):
            ids = c.encode(b.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), type=schema.field(1).type)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, IDS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row's ids."""
    schema = arrow_schema(TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"]).mapInArrow(run, TEXTS)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every text, decode its ids, keep digests of both."""
    schema = arrow_schema(DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, "text", SLICE_BYTES):
            n, encoded, decoded = [], [], []
            for ids in c.encode(b.column(1).to_pylist()):
                listed = ids.tolist()
                n.append(len(listed))
                encoded.append(hashlib.sha256(",".join([c.decimal[i] for i in listed]).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(listed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(encoded), pa.array(decoded)], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, DIGESTS)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    return digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
