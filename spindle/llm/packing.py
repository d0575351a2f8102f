"""Operator 10, packing: vector bin packing with the dot-product heuristic.

Training sequences have limits on several things at once: tokens, segments
(pieces of documents) and loss-bearing tokens.  A piece's demand and a
sequence's free room are vectors over those limits, each divided by its
limit; the next piece of a sequence is the one that fits and whose demand has
the largest dot product with the free room.

Documents may be cut.  A document first gives pieces that fill a sequence by
themselves; what remains waits in a pool of bounded size.  When nothing in
the pool fits a sequence any more, the largest piece is cut to fill the gap.
A sequence that can't be filled (the segment or loss limit is reached, or the
partition ends) is trimmed to a power of two of tokens, and what is cut off
goes back to the pool, so no sequence needs padding.

Every task packs the rows of its partition in the order they come, with a
pool of at most ``POOL`` pieces; nothing is shuffled and a hot source only
means more rows.  Sequence ids are unique over all tasks: the partition's
number in the upper bits, a counter in the lower 33.

Ids come from a vocabulary file in the tokenizers library's format, as that
library encodes without adding special tokens.  If the file's ids follow its
merges (byte-level vocabularies do), the same ids are made by tiktoken from the
file's vocabulary, which is five times as fast; else by the tokenizers library.
Long texts go to tiktoken in pieces that words don't cross; a piece on which its
regular expressions give up (about a million blanks in a row) goes to tokenizers.

Defined results
* null or empty text: the separator alone; repeated rows: each is packed
* very long texts: as many pieces as they need, one text in memory at a time
* other columns are ignored; empty table: no rows
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, read_table, slices

#: Pieces that wait for a place in a task; bytes of text worked on at a time.
POOL, SLICE_BYTES = 1024, 1 << 20
#: Characters that tiktoken gets at a time, up to the next place that words don't cross.
PIECE_CHARS, SAFE_CUT = 1 << 18, re.compile(r"(?<=\w) (?=\w)")
#: Separator after every document.
SEPARATOR = 0


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024


@dataclass
class Piece:
    """Tokens [start, stop) of a document; those before ``loss_from`` bear no loss."""

    doc: tuple  # (id, tokens) of the document
    ids: np.ndarray
    start: int
    loss_from: int

    def tokens(self) -> int:
        return len(self.ids)

    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.loss_from))

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (
            Piece(self.doc, self.ids[:n], self.start, self.loss_from),
            Piece(self.doc, self.ids[n:], self.start + n, self.loss_from),
        )


class Packer:
    """Packs pieces as they come; ``emit(pieces)`` gets every finished sequence."""

    def __init__(self, limits: Limits, emit: Callable[[list[Piece]], None]) -> None:
        self.limits, self.emit = limits, emit
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
        self.pool: list[Piece] = []

    def add(self, piece: Piece) -> None:
        """Cut off what fills a sequence by itself; the rest waits."""
        lim = self.limits
        while piece.tokens() >= lim.tokens or piece.loss() >= lim.loss_tokens:
            n = self._room(piece, lim.tokens, lim.loss_tokens)
            if n < lim.tokens and n & (n - 1):
                n = 1 << n.bit_length() - 1
            head, piece = piece.cut(n)
            self.emit([head])
        if piece.tokens():
            self.pool.append(piece)

    @staticmethod
    def _room(piece: Piece, tokens: int, loss: int) -> int:
        """How many of the piece's first tokens fit."""
        return min(piece.tokens(), tokens, loss + max(0, piece.loss_from - piece.start))

    def run(self, down_to: int) -> None:
        """Make sequences until at most ``down_to`` pieces wait."""
        while len(self.pool) > down_to:
            self._one()

    def _one(self) -> None:
        lim, pool = self.limits, self.pool
        need = np.array([(p.tokens(), 1, p.loss()) for p in pool], np.float64)
        room, taken, own = self.cap.copy(), [], np.ones(len(pool), bool)
        while room[0] >= 1 and room[1] >= 1:
            fits = own & (need <= room).all(axis=1)
            if fits.any():
                score = np.where(fits, (need / self.cap) @ (room / self.cap), -1.0)
                i = int(score.argmax())
                own[i] = False
                taken.append(pool[i])
                room -= need[i]
                continue
            if not own.any():
                break
            i = int(np.where(own, need[:, 0], -1).argmax())
            n = self._room(pool[i], int(room[0]), int(room[2]))
            if n < 1:
                break
            head, rest = pool[i].cut(n)
            taken.append(head)
            pool[i] = rest
            room -= (head.tokens(), 1, head.loss())
            need[i] = (rest.tokens(), 1, rest.loss())
            if not rest.tokens():
                own[i] = False
        self.pool = [p for p, o in zip(pool, own.tolist(), strict=True) if o]
        total = sum(p.tokens() for p in taken)
        extra = 0 if total == lim.tokens else total - (1 << total.bit_length() - 1)
        while extra:
            last = taken.pop()
            keep = max(0, last.tokens() - extra)
            extra -= last.tokens() - keep
            head, rest = last.cut(keep)
            if keep:
                taken.append(head)
            self.pool.append(rest)
        self.emit(taken)


class Tokens:
    """Ids of texts as the tokenizers library makes them from one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pre = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if plain and len(vocab) - len(self.special) <= 256 + len(merges) and all(vocab[a + b] == 256 + r for r, (a, b) in enumerate(merges)):
            import tiktoken

            from .bpe import PATTERN, byte_alphabet

            alphabet = byte_alphabet()
            ranks = {bytes(alphabet[c] for c in s): i for s, i in vocab.items() if s not in self.special}
            self.fast, self.slow = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special), None
        else:
            self.fast, self.slow = None, library(path)

    def ids(self, text: str) -> np.ndarray:
        if self.slow is not None:
            return _library_ids(self.slow, text)
        parts = [self._piece(p) for p in self._pieces(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _pieces(self, text: str) -> Iterator[str]:
        """The text in pieces that neither words nor special tokens cross."""
        at = 0
        while len(text) - at > PIECE_CHARS and not any(" " in s for s in self.special):
            cut = SAFE_CUT.search(text, at + PIECE_CHARS)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _piece(self, text: str) -> np.ndarray:
        allowed = "all" if any(s in text for s in self.special) else set()
        try:
            return self.fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype(np.uint32, copy=False)
        except ValueError:  # the regular expression's stack is full
            return _library_ids(library(self.path), text)


@lru_cache(maxsize=2)
def library(path: str):
    """The vocabulary file in the tokenizers library."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def _library_ids(tokenizer, text: str) -> np.ndarray:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


PIECES = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, path: str, limits: Limits = Limits(), loss_from: str | None = None) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    ``loss_from`` names a column with the number of leading tokens of a
    document that bear no loss (a prompt); without it every token does.
    Columns: doc_id, start (the document's ids before the piece), length,
    ids_crc32 (of the little-endian unsigned 32-bit ids), doc_tokens (with
    the separator), sequence_id, offset (in the sequence).
    """
    schema = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sequence = [], TaskContext.get().partitionId() << 33
        tokens = tokens_of(path)

        def emit(pieces: list[Piece]) -> None:
            nonlocal sequence
            at = 0
            for p in pieces:
                key, doc_tokens = p.doc
                made.append((key, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), doc_tokens, sequence, at))
                at += len(p.ids)
            sequence += 1

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], schema=schema)
            made.clear()
            return out

        packer = Packer(limits, emit)
        for b in slices(batches, "text", SLICE_BYTES):
            for key, text, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.append(tokens.ids(text or ""), np.uint32(SEPARATOR))
                packer.add(Piece((key, len(ids)), ids, 0, first))
                if len(packer.pool) >= POOL:
                    packer.run(POOL // 2)
            if made:
                yield table()
        packer.run(0)
        if made:
            yield table()

    first = F.lit(0) if loss_from is None else F.greatest(F.lit(0), F.coalesce(F.col(loss_from), F.lit(0)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", first.cast("int").alias("loss_from")).mapInArrow(run, PIECES)


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
