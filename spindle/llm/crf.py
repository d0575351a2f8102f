"""Operator 3, quality classifier: a linear-chain conditional random field over lines.

Every line of a document is good or bad.  A line's features are shares of
character classes, its length, words that repeat the word before and a flag
for a line seen earlier in the text, for the line itself and its two
neighbours.  Pairs of neighbouring labels have weights of their own.  The
forward-backward algorithm gives each line's probability of being good.  Their
mean weighted by line length is the document's share of good text, and a
logistic curve over the share gives the score, the probability of label 1.

Labels mark documents, not lines, so a line's label is latent.  It starts as its
document's; a model of the line's own features, fitted to that, and then the
chain itself relabel the lines in ``ROUNDS`` rounds of hard expectation and
maximisation.  The document's label constrains them: at least ``AT_LEAST`` of a
document's length bears its label, the lines that fit it best; the others bear
what the model says.  So clean lines of a bad document become good and junk in a
good one bad, and the chain learns where labels change.  The weights are fitted in
one task on a bounded sample:
``TRAIN_DOCS`` labelled documents with the smallest hash among the training
rows; all documents are scored.  Only the text is an input.

Features of a whole batch of texts come from prefix sums over its bytes, so
work per byte is a handful of numpy passes; chains of all documents of a batch
advance together.

Defined results
* null or empty text: one empty line, scored like any line
* no labelled rows, or of one class only: every score is the share of label 1 (0.5 without rows)
* a document labelled several times: its larger label; labels of unknown documents: ignored
* repeated rows: each gets the same score; null doc_id: scored, held out as the empty string's checksum says
* very long texts: linear; empty table: no rows; other columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, read_table, slices

#: Labelled documents that the weights are fitted on; steps and rate of the ascent; penalty on squared weights.
TRAIN_DOCS, STEPS, RATE, PENALTY = 4000, 200, 0.5, 1e-5
#: Penalty on squared weights of neighbours' features: a line's own features speak first.
PENALTY_BESIDE = 1e-3
#: Rounds in which lines are labelled anew; the least share of a document's length that bears its label.
ROUNDS, AT_LEAST = 2, 0.3
#: A document is predicted good from this score on; the share of documents held out is one in FOLDS.
GOOD, FOLDS = 0.3, 5
SLICE_BYTES = 1 << 20

_CLASSES = ("#*$%&<>^~=_{}[]\\@", "|", "!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-", " \t")
OWN = len(_CLASSES) + 7  # with the share of letters, length, few words, empty, word length, repeats, seen before
N_FEATURES = 3 * OWN + 1


def _tables() -> np.ndarray:
    """By class and byte: whether it belongs to the class; then letters, and first bytes of characters."""
    t = np.zeros((len(_CLASSES) + 2, 256), np.uint8)
    for i, chars in enumerate(_CLASSES):
        t[i, list(chars.encode())] = 1
    t[-2, [*range(65, 91), *range(97, 123), *range(192, 256)]] = 1
    t[-1] = 1
    t[-1, 128:192] = 0
    return t


_TABLES = _tables()
_RNG = np.random.Generator(np.random.PCG64(7))
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 0x5851F42D4C957F2D


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of _STEP and of its inverse modulo 2^64, as far as needed


def _prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes."""
    n = len(raw)
    if len(_POWERS[0]) <= n:
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            steps = np.full(n + n // 4 + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[raw] * _POWERS[0][:n], out=sums[1:])
    return sums


def _spans_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, equal for equal spans."""
    x = (sums[end] - sums[begin]) * _POWERS[1][begin]
    return x ^ (x >> np.uint64(29))


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, characters of each line, lines of each text)."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    doc_end = np.cumsum([len(t) for t in texts])
    doc_begin = doc_end - [len(t) for t in texts]
    breaks = np.flatnonzero(raw == 10)
    doc_of = np.searchsorted(doc_end, breaks, "right")
    n_lines = 1 + np.bincount(doc_of, minlength=len(texts))
    first = np.cumsum(n_lines) - n_lines
    total = int(n_lines.sum())
    doc = np.repeat(np.arange(len(texts)), n_lines)
    is_first = np.zeros(total, bool)
    is_first[first] = True
    is_last = np.roll(is_first, -1)
    begin, end = np.empty(total, np.int64), np.empty(total, np.int64)
    begin[is_first], begin[~is_first] = doc_begin, breaks + 1
    end[is_last], end[~is_last] = doc_end, breaks

    def counted(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, dtype=np.int32, out=sums[1:])
        return (sums[end] - sums[begin]).astype(np.float32)

    chars = counted(_TABLES[-1][raw])
    some = np.maximum(chars, 1)
    share = [np.sqrt(counted(_TABLES[i][raw]) / some) for i in range(len(_CLASSES) + 1)]
    # Words: runs without white space; a word that equals the one before it on its line is a repeat.
    inside = raw > 32
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    # A text may end and the next begin without white space between them.
    cut = doc_begin[(doc_begin > 0) & (doc_begin < len(raw))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]])
    w_begin, w_end = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut])), np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
    sums = _prefix_sums(raw)
    word = _spans_hash(sums, w_begin, w_end)
    line_of = np.searchsorted(begin, w_begin, "right") - 1
    n_words = np.bincount(line_of, minlength=total).astype(np.float32)
    again = np.flatnonzero((word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])) + 1
    repeats = np.bincount(line_of[again], minlength=total) / np.maximum(n_words, 1)
    # A line seen earlier in its text: not the first of its (text, hash).
    key = _spans_hash(sums, begin, end)
    order = np.lexsort((np.arange(total), key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    seen = np.zeros(total, np.float32)
    seen[order[1:][same]] = 1
    seen *= chars > 0
    own = np.stack(
        [*share, np.log1p(chars) / 8, (n_words < 4) & (n_words > 0), chars == 0, np.minimum(chars / np.maximum(n_words, 1) / 12, 2), np.sqrt(repeats), seen],
        axis=1,
    ).astype(np.float32)
    x = np.zeros((total, N_FEATURES), np.float32)
    x[:, 0] = 1
    x[:, 1 : 1 + OWN] = own
    x[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1] * ~is_first[1:, None]
    x[:-1, 1 + 2 * OWN :] = own[1:] * ~is_last[:-1, None]
    return x, chars, n_lines


def marginals(good: np.ndarray, n_lines: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good of each line, expected counts of label pairs, and the log partition sum, by forward-backward.

    ``good``: a line's log potential of good (bad has 0); ``trans[a, b]``: of label b after a.
    """
    first = np.cumsum(n_lines) - n_lines
    by_length = np.argsort(-n_lines, kind="stable")
    first, lens = first[by_length], n_lines[by_length]
    longest = int(lens[0]) if len(lens) else 0
    active = np.searchsorted(-lens, -np.arange(longest), "left")  # documents with more than t lines
    node = np.zeros((len(good), 2))
    node[:, 1] = good
    a, b = np.empty((len(good), 2)), np.zeros((len(good), 2))
    for t in range(longest):
        at = first[: active[t]] + t
        if t:
            prev = a[at - 1]
            a[at] = np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1]) + node[at]
        else:
            a[at] = node[at]
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        nxt = b[at + 1] + node[at + 1]
        b[at] = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
    z = np.logaddexp(*(a[first + lens - 1]).T)
    z_of = np.empty(len(n_lines))
    z_of[by_length] = z
    z_line = np.repeat(z_of, n_lines)
    p = np.exp(np.minimum(a[:, 1] + b[:, 1] - z_line, 0))
    counts = np.zeros((2, 2))
    if pairs:
        inner = np.ones(len(good), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        for i in (0, 1):
            for j in (0, 1):
                counts[i, j] = np.exp(a[at - 1, i] + trans[i, j] + node[at, j] + b[at, j] - z_line[at]).sum()
    return p, counts, float(z.sum())


def _ascend(slope_at, penalty: np.ndarray) -> np.ndarray:
    """Weights by gradient ascent (Adam); ``slope_at(theta)`` is the slope of the likelihood, ``penalty`` that of each weight."""
    theta, m, v = np.zeros(len(penalty)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        slope = slope_at(theta) - penalty * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _fit_chain(x: np.ndarray, y: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Weights of the features, then of the four label pairs, for lines with labels ``y``."""
    inner = np.ones(len(y), bool)
    inner[np.cumsum(n_lines) - n_lines] = False
    at = np.flatnonzero(inner)
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[at - 1].astype(int), y[at].astype(int)), 1)

    def slope(theta: np.ndarray) -> np.ndarray:
        p, pairs, _ = marginals(x @ theta[:-4], n_lines, theta[-4:].reshape(2, 2), pairs=True)
        return np.concatenate([x.T @ (y - p), (gold - pairs).ravel()]) / len(y)

    penalty = np.full(N_FEATURES + 4, PENALTY)
    penalty[1 + OWN : N_FEATURES] = PENALTY_BESIDE
    return _ascend(slope, penalty)


def relabelled(p: np.ndarray, weight: np.ndarray, n_lines: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The likelier label of each line, but its document's for the lines that fit it best, up to AT_LEAST of the length.

    ``p``: probability of good of each line; lines that fit equally: the earlier first.
    """
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    own = labels[doc].astype(bool)
    order = np.lexsort((np.arange(len(p)), np.where(own, -p, p), doc))
    before = np.cumsum(weight[order]) - weight[order]
    start = np.repeat(before[np.cumsum(n_lines) - n_lines], n_lines)
    total = np.repeat(np.add.reduceat(weight, np.cumsum(n_lines) - n_lines), n_lines)
    forced = np.empty(len(p), bool)
    forced[order] = before - start < AT_LEAST * total
    return np.where(forced, own, p >= 0.5).astype(np.float64)


def fit(texts: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Weights of the features, of the four label pairs, then slope and offset of the score's curve."""
    # Some texts at a time: the work arrays are many times as large as the texts.
    parts, batch, size = [], [], 0
    for i, text in enumerate(texts):
        batch.append(text)
        size += len(text)
        if size > SLICE_BYTES or i == len(texts) - 1:
            parts.append(line_features(batch))
            batch, size = [], 0
    x, chars, n_lines = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2))
    weight = chars.astype(np.float64) + 1
    # The first labels come from a line's own features: a neighbour's would carry the document's label over.
    alone, y = x[:, : 1 + OWN], np.repeat(labels, n_lines).astype(np.float64)
    theta = _ascend(lambda w: alone.T @ (y - _logistic(alone @ w)) / len(y), np.full(1 + OWN, PENALTY))
    p = _logistic(alone @ theta)
    for _ in range(ROUNDS):
        theta = _fit_chain(x, relabelled(p, weight, n_lines, labels), n_lines)
        p = marginals(x @ theta[:-4], n_lines, theta[-4:].reshape(2, 2))[0]
    share = _share(p, weight, n_lines)
    basis = np.stack([share - 0.5, np.ones(len(share))], axis=1)
    curve = _ascend(lambda w: basis.T @ (labels - _logistic(basis @ w)) / len(labels), np.full(2, PENALTY))
    return np.concatenate([theta, [max(curve[0], 0.0), curve[1]]])


def _share(p: np.ndarray, weight: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """The mean of ``p`` weighted by length, by document."""
    first = np.cumsum(n_lines) - n_lines
    return np.clip(np.add.reduceat(weight * p, first) / np.add.reduceat(weight, first), 0, 1)


def line_probabilities(texts: list[bytes], theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of good of each line, its weight, lines of each text)."""
    x, chars, n_lines = line_features(texts)
    p, _, _ = marginals((x @ theta[:-6].astype(np.float32)).astype(np.float64), n_lines, theta[-6:-2].reshape(2, 2))
    return p, chars.astype(np.float64) + 1, n_lines


def score(texts: list[bytes], theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score from the share of good text, lines, lines more likely bad than good) of each text."""
    p, weight, n_lines = line_probabilities(texts, theta)
    total = _logistic(theta[-2] * (_share(p, weight, n_lines) - 0.5) + theta[-1])
    return total, n_lines, np.add.reduceat(p < 0.5, np.cumsum(n_lines) - n_lines, dtype=np.int64)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> list[float]:
    """Weights of the model; a single number (the share of label 1) if there is nothing to tell apart."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label").repartition(1)
    out = T.StructType([T.StructField("theta", T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[bytes, int]] = {}
        for b in batches:
            for key, text, y in zip(b.column(0).to_pylist(), _bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                found[key] = max((text, y), found.get(key, (b"", y)))  # a repeated id counts once
        texts, ys = [found[k][0] for k in sorted(found)], np.array([found[k][1] for k in sorted(found)], float)
        theta = fit(texts, ys) if 0 < ys.sum() < len(ys) else np.array([ys.mean() if len(ys) else 0.5])
        yield pa.RecordBatch.from_arrays([pa.array([theta.tolist()], out_schema.field(0).type)], schema=out_schema)

    out_schema = arrow_schema(out)
    got = rows.mapInArrow(run, out).first()
    return list(got["theta"]) if got else [0.5]


SCORES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_bad_lines", T.LongType()),
    ]
)


def _scored(column: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = _bytes(column)
    if len(weights) == 1:
        return np.full(len(texts), weights[0]), np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64)
    return score(texts, weights)


def scores(docs: DataFrame, theta: list[float]) -> DataFrame:
    """(doc_id, score, n_lines, n_bad_lines) of every row."""
    weights, schema = np.array(theta), arrow_schema(SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            got = _scored(b.column(1), weights)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(got, list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def good_documents(docs: DataFrame, theta: list[float]) -> DataFrame:
    """The rows whose score reaches GOOD, with all their columns."""
    weights = np.array(theta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            got = _scored(b.column(b.schema.get_field_index("text")), weights)
            yield b.filter(pa.array(got[0] >= GOOD))

    return docs.mapInArrow(run, docs.schema)


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    theta = train(docs, read_table(spark, sf_dir, "labels"))
    found = scores(docs, theta)
    return found.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
        "n_lines",
        "n_bad_lines",
    )
