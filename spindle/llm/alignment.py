"""Operator 11, cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers cut the same bytes.  An occurrence of a token of A and one of B
are linked if their byte ranges overlap; between two neighbouring ends of
either tokenizer's tokens lies exactly one link.  Places where tokens of both
end cut a document into groups.  Single spaces between words are such places,
so a task encodes and aligns each different word once (``Aligner``).

1. Tasks number their documents: chunks of at most ``CHUNK_DOCS`` documents (and
   about ``CHUNK_BYTES`` of text) and the place in the chunk.  For every id
   pair of a chunk the index holds multiplicity planes: plane k is a bitmap of
   the documents in which bit k of the pair's number of links is set.  A
   bitmap is compressed as its sorted members or as plain bits, whichever is
   shorter.  A chunk's bitmap is one container of the pair's whole bitmap.
2. OR-merging the planes and counting bits gives a pair's documents, bits
   weighted by their plane give its links.  Containers of different chunks
   hold different documents, so their counts add up: a grouping by pair whose
   rows are chunks, not links.  A pair that is linked more often than any
   other of its B id is that id's best (ties included).
3. The counts go back to the chunks (rows of pair and chunk, no bitmaps in
   that shuffle), and each chunk's postings return the scores to its documents.

Nothing is broadcast or collected; a chunk's memory is bounded by its text.

Defined results
* null or empty text, or one that either tokenizer doesn't give back byte for byte (after the leading space): no tokens, zeros, ''
* control strings of either vocabulary inside texts are plain text
* repeated rows: each is a document; null doc_id: a row like any other
* very long texts: whole, in a slice of their own; equal counts: every tied pair is best
* empty table: no rows; other columns are ignored
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, read_table, slices, written
from .packing import PIECE_CHARS, SAFE_CUT

CHUNK_DOCS, CHUNK_BYTES, SLICE_BYTES = 1 << 16, 8 << 20, 1 << 20
#: What a worker remembers of segments, about, before it forgets them all (between chunks).
KNOWN_BYTES = 128 << 20
#: A place that no token of either tokenizer crosses: a space between two visible characters.
_CUT, _BLANKS = re.compile(r"(?<=\S) (?=\S)"), re.compile(r" \s|\s ")


class ByteBpe:
    """Tokens of a byte-level vocabulary file of the tokenizers library; special strings are plain text."""

    def __init__(self, path: str) -> None:
        import tiktoken

        from .bpe import PATTERN, byte_alphabet

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.path, self.fast = path, tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.table = _by_id(vocab)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.concatenate([self._piece(p) for p in _pieces(t)]) for t in texts]

    def _piece(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)
        except ValueError:  # the regular expression's stack is full
            return np.array(_library(self.path).encode(text, add_special_tokens=False).ids, np.int64)


class PieceBpe:
    """Tokens of a sentencepiece model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {i: self.model.id_to_piece(i) for i in range(self.model.get_piece_size())}
        hexed = {i: re.fullmatch("<0x([0-9A-F]{2})>", s) for i, s in pieces.items()}
        self.table = [bytes([int(hexed[i][1], 16)]) if hexed[i] else s.replace("▁", " ").encode() for i, s in pieces.items()]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


def _by_id(vocab: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for s, i in vocab.items():
        out[i] = s
    return out


def _segments(text: str) -> list[str]:
    if text[0] == " " or text[-1] == " " or _BLANKS.search(text):
        return _CUT.split(text)
    return text.split(" ")  # every space is a cut


def _pieces(text: str) -> Iterator[str]:
    """Pieces of a text that its words don't cross."""
    at = 0
    while len(text) - at > PIECE_CHARS and (cut := SAFE_CUT.search(text, at + PIECE_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    out.encode_special_tokens = True
    return out


@lru_cache(maxsize=4)
def _tokenizer(kind: type, path: str):
    return kind(path)


class Aligner:
    """Both tokenizers of a worker, and what they make of the segments met so far.

    A text is cut at single spaces between two visible characters.  No word of A's pattern and, as the constructor
    asserts, no piece of B crosses such a place, so both tokenizers have an end there and a segment (with the space
    before it) gives the same tokens, groups and links wherever it stands.  Segments are numbered; ``n_a``, ``n_b``,
    ``n_groups``, ``n_links`` hold their counts, ``names`` their groups as text, and ``links[first[i]:first[i + 1]]`` their
    linked pairs (a times the size of B's vocabulary, plus b).
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = _tokenizer(ByteBpe, path_a), _tokenizer(PieceBpe, path_b)
        self.len_a, self.len_b = (np.array([len(s) for s in t.table], np.int64) for t in (self.a, self.b))
        self.n_pairs_b = len(self.len_b)
        self.cuts = not any(re.search("[^ ] ", s.decode("utf-8", "replace")) for s in self.b.table)
        n_a, n_b = len(self.len_a), len(self.len_b)
        # Decimal ids and what follows them: entry 2 * id inside a group, 2 * id + 1 at the end of its half.
        self.digits = [str(i) + c for i in range(n_a) for c in ",|"] + [str(i) + c for i in range(n_b) for c in ",;"]
        self.forget()

    def forget(self) -> None:
        self.known: dict = {}
        self.bad: set = set()
        self.names, self.bytes = [], 0
        self.n_a, self.n_b, self.n_groups, self.n_links, self.links = ([] for _ in range(5))

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """The segments of every text, by number; none for one that a tokenizer doesn't give back."""
        split = [(_segments(t) if self.cuts else [(t,)]) if t else [] for t in texts]
        self._add(split)
        if self.bad:
            # A text with a segment that doesn't come back is encoded whole: only that tells.
            split = [x if self.bad.isdisjoint(x) else [(t,)] for x, t in zip(split, texts, strict=True)]
            self._add(split)
        found = [np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments)) for segments in split]
        return [x[:0] if self.bad and not self.bad.isdisjoint(segments) else x for x, segments in zip(found, split, strict=True)]

    def _add(self, split: list[list]) -> None:
        """Encode and align new segments.  Those that start and end with a visible character go through the tokenizers
        as one text, spaces between them, since no token crosses these; others go alone."""
        new = [x for x in dict.fromkeys(chain.from_iterable(split)) if x not in self.known]
        joined = [x for x in new if isinstance(x, str) and not (x[0].isspace() or x[-1].isspace())]
        self._encode(joined)
        for x in new:
            if x not in self.known:
                self._encode([x])

    def _encode(self, keys: list) -> None:
        if not keys:
            return
        text = " ".join(x if isinstance(x, str) else x[0] for x in keys)
        raw = (" " + text).encode("utf-8", "surrogatepass")
        (a,), (b,) = self.a.encode([" " + text]), self.b.encode([text])
        good = all(b"".join(map(x.table.__getitem__, ids.tolist())) == raw for x, ids in ((self.a, a), (self.b, b)))
        if not good and len(keys) > 1:
            self._encode(keys[: len(keys) // 2])
            self._encode(keys[len(keys) // 2 :])
            return
        at = len(self.known)
        self.known.update(zip(keys, range(at, at + len(keys)), strict=True))
        self.bytes += len(raw) + 300 * len(keys)
        if not good:
            self.bad.update(keys)
            self.names.append("")
            for have in (self.n_a, self.n_b, self.n_groups, self.n_links):
                have.append(np.zeros(1, np.int64))
            return
        stop = np.cumsum([len(x.encode("utf-8", "surrogatepass")) + 1 for x in keys]) if len(keys) > 1 else np.array([len(raw)])
        *counted, links, names = self._align(a, b, stop)
        self.names += names
        self.bytes += 8 * len(links)
        for have, more in zip((self.n_a, self.n_b, self.n_groups, self.n_links, self.links), (*counted, links), strict=True):
            have.append(more)

    def _align(self, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> tuple:
        """Tokens of A and B, groups and links of the segments that end at the bytes ``stop``, the links, the groups as text."""
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        cuts = np.concatenate([end_a, end_b])
        cuts.sort(kind="stable")
        twice = cuts[1:] == cuts[:-1]  # an end is at most once in each
        both, ends = cuts[1:][twice], np.concatenate([cuts[:-1][~twice], cuts[-1:]])
        links = a[np.searchsorted(end_a, ends)] * self.n_pairs_b + b[np.searchsorted(end_b, ends)]
        per_segment = lambda x: np.diff(np.searchsorted(x, stop, side="right"), prepend=0)
        n_a, n_b = per_segment(end_a), per_segment(end_b)
        # Tokens in the order of the groups, A before B.
        stop_a, stop_b = np.searchsorted(end_a, both) + 1, np.searchsorted(end_b, both) + 1
        size_a, size_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        place_a = np.arange(len(a)) + np.repeat(stop_b - size_b, size_a)
        place_b = np.arange(len(b)) + np.repeat(stop_a, size_b)
        code = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[stop_a - 1] = 1
        last_b[stop_b - 1] = 1
        code[place_a] = 2 * a + last_a
        code[place_b] = 2 * (len(self.len_a) + b) + last_b
        digits, at, names = list(map(self.digits.__getitem__, code.tolist())), 0, []
        for n in (n_a + n_b).tolist():
            names.append("".join(digits[at : at + n])[:-1])
            at += n
        return n_a, n_b, per_segment(both), per_segment(ends), links, names

    def tables(self) -> tuple[np.ndarray, ...]:
        """n_a, n_b, n_groups, n_links and links of all segments so far, as arrays."""
        for have in (self.n_a, self.n_b, self.n_groups, self.n_links, self.links):
            have[:] = [np.concatenate(have) if have else np.empty(0, np.int64)]
        return tuple(x[0] for x in (self.n_a, self.n_b, self.n_groups, self.n_links, self.links))

    def digest(self, numbers: np.ndarray) -> str:
        return hashlib.sha256(";".join(map(self.names.__getitem__, numbers.tolist())).encode()).hexdigest() if len(numbers) else ""


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# ---------------------------------------------------------------------------
# Compressed bitmaps of the documents of a chunk
# ---------------------------------------------------------------------------

def container(members: np.ndarray, width: int) -> bytes:
    """Sorted distinct members below ``width``: a tag, then the members as 16-bit numbers or plain bits."""
    if 16 * len(members) <= width:
        return b"m" + members.astype("<u2").tobytes()
    bits = np.zeros(width, np.uint8)
    bits[members] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def members(data: bytes) -> np.ndarray:
    if data[:1] == b"m":
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little"))


def popcount(data: bytes) -> int:
    if data[:1] == b"m":
        return (len(data) - 1) // 2
    return int(np.bitwise_count(np.frombuffer(data, np.uint8, offset=1)).sum())


def merged(a: bytes, b: bytes, width: int) -> bytes:
    """The OR of two bitmaps."""
    both = np.sort(np.concatenate([members(a), members(b)]))
    return container(both[np.append(True, both[1:] != both[:-1])] if len(both) else both, width)


def planes(docs: np.ndarray, times: np.ndarray, width: int) -> list[bytes]:
    """Multiplicity planes of a posting: sorted documents and how often each holds the pair."""
    return [container(docs[(times >> k & 1) == 1], width) for k in range(int(times.max()).bit_length())]


def counts(posting: list[bytes], width: int) -> tuple[int, int]:
    """Documents (popcount of the OR of all planes) and links (popcounts weighted by plane)."""
    any_of = posting[0]
    for p in posting[1:]:
        any_of = merged(any_of, p, width)
    return popcount(any_of), sum(popcount(p) << k for k, p in enumerate(posting))


def inverted(places: np.ndarray, segments: np.ndarray, n_links: np.ndarray, links: np.ndarray, width: int) -> Iterator[tuple[int, list[bytes]]]:
    """(pair, planes) of every pair of a chunk, from the place (below 2^16) of each segment's occurrence; pairs are below 2^47."""
    first, n = (np.cumsum(n_links) - n_links)[segments], n_links[segments]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    keys = np.sort(links[np.repeat(first, n) + inside] << 16 | np.repeat(places, n))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(np.append(new, len(keys)))
    pairs, places = keys[new] >> 16, keys[new] & 0xFFFF
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(pairs)], strict=True):
        yield int(pairs[lo]), planes(places[lo:hi], times[lo:hi], width)


_LONG, _TEXT = T.LongType(), T.StringType()
INDEX = T.StructType(
    [
        T.StructField("chunk", _LONG),
        # of a document
        T.StructField("place", _LONG),
        T.StructField("doc_id", _LONG),
        T.StructField("n_a", _LONG),
        T.StructField("n_b", _LONG),
        T.StructField("n_groups", _LONG),
        T.StructField("n_links", _LONG),
        T.StructField("groups_sha256", _TEXT),
        # of a pair
        T.StructField("a_id", _LONG),
        T.StructField("b_id", _LONG),
        T.StructField("n_docs", _LONG),
        T.StructField("links", _LONG),
        T.StructField("planes", T.ArrayType(T.BinaryType(), False)),
    ]
)
DOCUMENT, PAIR = INDEX.names[1:8], INDEX.names[8:]


def index(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Documents (chunk, place, doc_id, n_a, n_b, n_groups, n_links, groups_sha256) and postings (chunk, a_id, b_id,
    n_docs, links, planes), from one pass over the texts."""
    schema = arrow_schema(INDEX)

    def table(chunk: int, names: list[str], found: list[tuple]) -> pa.RecordBatch:
        cols = dict(zip(names, zip(*found, strict=True), strict=True)) | {"chunk": [chunk] * len(found)}
        return pa.RecordBatch.from_arrays([pa.array(cols.get(f.name, [None] * len(found)), f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        chunk, n, size, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def postings() -> Iterator[pa.RecordBatch]:
            rows = []
            places = np.repeat(np.arange(n), [len(x) for x in held])
            if len(places):
                *_, n_links, links = aligner.tables()
                for pair, posting in inverted(places, np.concatenate(held), n_links, links, n):
                    rows.append((*divmod(pair, aligner.n_pairs_b), *counts(posting, n), posting))
                    if len(rows) == 10_000:
                        yield table(chunk, PAIR, rows)
                        rows = []
            if rows:
                yield table(chunk, PAIR, rows)

        for batch in slices(batches, "text", SLICE_BYTES):
            for lo in range(0, batch.num_rows, CHUNK_DOCS):
                part = batch.slice(lo, CHUNK_DOCS)
                if n and (n + part.num_rows > CHUNK_DOCS or size > CHUNK_BYTES):
                    yield from postings()
                    chunk, n, size, held = chunk + 1, 0, 0, []
                    if aligner.bytes > KNOWN_BYTES:
                        aligner.forget()
                found = aligner.numbers(part.column(1).to_pylist())
                per_segment = aligner.tables()[:4]
                sums = [[int(x[numbers].sum()) for x in per_segment] for numbers in found]
                yield table(chunk, DOCUMENT, [(n + i, key, *sums[i], aligner.digest(found[i])) for i, key in enumerate(part.column(0).to_pylist())])
                held += found
                n += part.num_rows
                size += part.column(1).nbytes
        yield from postings()

    both = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), "alignment-index")
    return both.where("place IS NOT NULL").select("chunk", *DOCUMENT), both.where("a_id IS NOT NULL").select("chunk", *PAIR)


def pair_table(postings: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs, links, best): corpus-wide counts of every linked pair; best: no pair of its B id has more links."""
    pairs = postings.groupBy("a_id", "b_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("links").alias("links"))
    pairs = written(pairs, "alignment-pairs")
    most = pairs.groupBy("b_id").agg(F.max("links").alias("most"))
    return pairs.join(most, "b_id").select("a_id", "b_id", "n_docs", "links", (F.col("links") == F.col("most")).alias("best"))


SCORES = T.StructType([T.StructField(c, _LONG) for c in ("chunk", "place", "n_best", "count_sum")])


def returned_scores(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chunk, place, n_best, count_sum) of every document with links: sums over its links of the pair's scores."""
    keys = postings.select("chunk", "a_id", "b_id").join(pairs.select("a_id", "b_id", F.col("links").alias("count"), "best"), ["a_id", "b_id"])
    keys = keys.select(F.col("chunk").alias("of"), F.col("a_id").alias("a"), F.col("b_id").alias("b"), "count", "best")
    schema = arrow_schema(SCORES)

    def run(posted: pa.Table, scored: pa.Table) -> pa.Table:
        pair = lambda a, b: a.to_numpy() << 32 | b.to_numpy()
        have = pair(scored["a"], scored["b"])
        order = np.argsort(have)
        at = order[np.searchsorted(have, pair(posted["a_id"], posted["b_id"]), sorter=order)]
        count, best = scored["count"].to_numpy()[at], scored["best"].to_numpy()[at].astype(np.int64)
        sums, bests, seen = (np.zeros(CHUNK_DOCS, np.int64) for _ in range(3))
        for posting, c, is_best in zip(posted["planes"].to_pylist(), count.tolist(), best.tolist(), strict=True):
            for k, plane in enumerate(posting):
                docs = members(plane)  # distinct, so plain indexing adds once
                sums[docs] += c << k
                bests[docs] += is_best << k
                seen[docs] = 1
        place = np.flatnonzero(seen)
        chunk = np.full(len(place), posted["chunk"][0].as_py() if len(posted) else 0, np.int64)
        return pa.Table.from_arrays([pa.array(x) for x in (chunk, place, bests[place], sums[place])], schema=schema)

    return postings.select("chunk", "a_id", "b_id", "planes").groupBy("chunk").cogroup(keys.groupBy("of")).applyInArrow(run, SCORES)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found, postings = index(docs, path_a, path_b)
    scores = returned_scores(postings, pair_table(postings))
    score = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.join(scores, ["chunk", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", score("n_best"), score("count_sum"), "groups_sha256")


def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of all documents between the two vocabularies."""
    import public_tokenizers

    return align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
