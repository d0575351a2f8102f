"""Rows with all their tokens, and numpy kernels over them.

``token_rows`` gathers the texts of a key, not their tokens, so no (key, pos, token) row is shuffled; what
concerns one row alone (a random choice of its positions, its attributions) is then computed where the row lies.
A kernel sees one Arrow batch with the tokens as codes of the batch's dictionary.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..session import ship_package
from .md5 import numbered


def token_rows(rows: DataFrame, key: list[str], text: str = "text", tokens=T.word_tokens, pattern: str = T.WORD_PATTERN) -> DataFrame:
    """(key…, pos array<int>, tokens array<string>): one row per key that has tokens, ordered by (pos, token).

    Rows that share a key are one row, each with its own positions from 0, as in a long (key, pos, token) table.
    ``tokens`` are the matches of ``pattern``; a text without any is left out by a search, so that texts are split once."""
    texts = rows.where(F.lower(text).rlike(pattern)).groupBy(*key).agg(F.collect_list(text).alias("_x"))
    t = texts.select(*key, F.transform("_x", lambda x: tokens(x)).alias("_t"))
    placed = F.transform("_t", lambda a: F.transform(a, lambda x, i: F.struct(i.alias("pos"), x.alias("token"))))
    several = F.size("_t") > 1
    t = t.select(*key, F.when(several, F.array_sort(F.flatten(placed))).otherwise(placed[0]).alias("_t"))
    return t.select(*key, F.col("_t.pos").alias("pos"), F.col("_t.token").alias("tokens"))


def as_token_rows(tok: DataFrame, key: list[str]) -> DataFrame:
    """``tok``, if it has one row per key already; a long table (key…, pos, token) is gathered."""
    if "tokens" in tok.columns:
        return tok
    t = tok.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"))
    return t.select(*key, F.col("_t.pos").alias("pos"), F.col("_t.token").alias("tokens"))


def key_parts(key: list[str]) -> Column:
    """The parts of a key as ``concat_ws`` takes them: strings, without nulls."""
    return F.array_compact(F.array(*[F.col(k).cast("string") for k in key]))


#: Keys of the rows that draw together, about.
DRAWN = 1 << 17


def drawn_together(weights: np.ndarray) -> Iterator[range]:
    """Rows, in order, in groups of about DRAWN of their weights."""
    groups = np.cumsum(weights) // DRAWN
    starts = np.flatnonzero(np.diff(groups, prepend=-1)).tolist()
    for start, stop in zip(starts, [*starts[1:], len(weights)], strict=True):
        yield range(start, stop)


def kept_in_copies(parts: list[list[str]], reps: int, pos: list[np.ndarray], frac: float, seed) -> list[list[np.ndarray]]:
    """For each row and repetition the indexes of the max(1, int(frac·n)) positions with the smallest md5(seed:key:rep:pos), ascending."""
    heads = [":".join([str(seed), *p, str(rep), ""]).encode() for p in parts for rep in range(reps)]
    hashes, out = numbered(heads, [p for p in pos for _ in range(reps)], wide=True), []
    for i, p in enumerate(pos):
        n, kept = max(1, math.floor(len(p) * frac)), []
        for head, h in zip(heads[i * reps : (i + 1) * reps], hashes[i * reps : (i + 1) * reps], strict=True):
            order = np.argsort(h)
            if (h[order[1:]] == h[order[:-1]]).any():  # equal positions, or keys of equal first halves
                whole = [hashlib.md5(head + str(x).encode()).digest() for x in p.tolist()]
                order = np.array(sorted(range(len(p)), key=lambda k, whole=whole, p=p: (whole[k], p[k])), np.int64)
            kept.append(np.sort(order[:n]))
        out.append(kept)
    return out


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and values of a column of lists."""
    off = column.offsets.to_numpy()
    return off - off[0], column.flatten()


def _list_array(values: list, kind, names: pa.Array | None) -> pa.Array:
    """Lists of numbers; with ``names`` lists of codes, as strings."""
    off = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = pa.array(np.concatenate(values) if values else np.empty(0, np.int64))
    return pa.ListArray.from_arrays(pa.array(off), names.take(flat.cast(pa.int64())) if names is not None else flat.cast(kind))


def batch_of(records: list[tuple], keys: pa.RecordBatch, fields: list[StructField], names: pa.Array) -> pa.RecordBatch:
    """Records (row number of ``keys``, value per field): lists of strings are given as codes of ``names``."""
    at = pa.array([r[0] for r in records], pa.int64())
    columns = [keys.column(k).take(at) for k in range(keys.num_columns)]
    for i, f in enumerate(fields, 1):
        values, kind = [r[i] for r in records], _ARROW[f.dataType.simpleString()]
        if isinstance(f.dataType, ArrayType):
            columns.append(_list_array(values, kind, names if kind == pa.string() else None))
        else:
            columns.append(pa.array(values, kind))
    return pa.RecordBatch.from_arrays(columns, names=[*keys.schema.names, *[f.name for f in fields]])


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
_ARROW |= {f"array<{k}>": v for k, v in _ARROW.items()}

#: Records of a batch that a kernel gives back.
OUT_ROWS = 1_000


def map_rows(rows: DataFrame, key: list[str], columns: list[str], kernel, fields: list[StructField]) -> DataFrame:
    """``kernel(batch) -> (records, names)`` over the Arrow batches of ``key`` and ``columns``: a table (key…, fields…).

    The records of a batch come as an iterator, so that a few of them are held at a time."""
    ship_package(rows.sparkSession)
    schema = StructType([*[rows.schema[k] for k in key], *fields])
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = pa.RecordBatch.from_arrays([b.column(k) for k in range(n)], names=list(key))
            records, names = kernel(b)
            some = []
            for r in records:
                some.append(r)
                if len(some) >= OUT_ROWS:
                    yield batch_of(some, keys, fields, names)
                    some = []
            if some:
                yield batch_of(some, keys, fields, names)

    return rows.select(*key, *columns).mapInArrow(run, schema)


def kept_tokens(rows: DataFrame, key: list[str], reps: int, frac: float, seed) -> DataFrame:
    """(key…, rep, tokens): the kept tokens of every row and repetition, in order."""

    def kernel(b):
        off, pos = lists(b.column("pos"))
        _, tokens = lists(b.column("tokens"))
        parts, pos = b.column("_parts").to_pylist(), pos.to_numpy()

        def records():
            for some in drawn_together(np.diff(off) * reps):
                copies = kept_in_copies([parts[r] for r in some], reps, [pos[off[r] : off[r + 1]] for r in some], frac, seed)
                for r, of_row in zip(some, copies, strict=True):
                    for rep, kept in enumerate(of_row):
                        yield r, rep, off[r] + kept

        return records(), tokens

    fields = [StructField("rep", IntegerType()), StructField("tokens", ArrayType(StringType()))]
    return map_rows(rows.withColumn("_parts", key_parts(key)), key, ["pos", "tokens", "_parts"], kernel, fields)


def with_words(rows: DataFrame, key: list[str], reps: int = 0, frac: float = 0.9, seed=42) -> DataFrame:
    """``rows`` as (key…, pos, tokens, words, n, n_all, dropped, cuts).

    ``words`` are the distinct tokens of a row, ``n`` their number in it and ``n_all`` that in the row and its ``reps``
    perturbed copies (``kept_in_copies``).  A copy is known by the few indexes that it drops: ``dropped`` holds those
    of all copies, ``cuts`` where each copy's begin and end."""

    def kernel(b):
        off, pos_ = lists(b.column("pos"))
        _, values = lists(b.column("tokens"))
        enc = values.dictionary_encode()
        codes, pos, parts = enc.indices.to_numpy(), pos_.to_numpy(), b.column("_parts").to_pylist()

        def drawn():
            for some in drawn_together(np.diff(off) * max(1, reps)):
                yield from zip(some, kept_in_copies([parts[r] for r in some], reps, [pos[off[r] : off[r + 1]] for r in some], frac, seed), strict=True)

        def records():
            for r, copies in drawn():
                c, p = codes[off[r] : off[r + 1]], pos[off[r] : off[r + 1]]
                words, inv, n = np.unique(c, return_inverse=True, return_counts=True)
                n_all, dropped, cuts = n * (reps + 1), [np.empty(0, np.int64)], [0]
                for kept in copies:
                    gone = np.ones(len(p), bool)
                    gone[kept] = False
                    d = np.flatnonzero(gone)
                    n_all = n_all - np.bincount(inv[d], minlength=len(words))
                    dropped.append(d)
                    cuts.append(cuts[-1] + len(d))
                yield r, p, c, words, n, n_all, np.concatenate(dropped), np.array(cuts)

        return records(), enc.dictionary

    ints, longs, strings = ArrayType(IntegerType()), ArrayType(LongType()), ArrayType(StringType())
    kinds = {"pos": ints, "tokens": strings, "words": strings, "n": longs, "n_all": longs, "dropped": ints, "cuts": ints}
    fields = [StructField(c, t) for c, t in kinds.items()]
    return map_rows(rows.withColumn("_parts", key_parts(key)), key, ["pos", "tokens", "_parts"], kernel, fields)


# ---------------------------------------------------------------------------
# attributions of one row
# ---------------------------------------------------------------------------

class Draws:
    """The samples of some rows and copies, drawn together when the first one is asked for."""

    def __init__(self, samples: int, seed):
        self.parts, self.pos, self.samples, self.seed = [], [], samples, seed
        self._kept: dict = {}

    def add(self, parts: list[str], pos: np.ndarray) -> int:
        """The number of one more row."""
        self.parts.append(parts)
        self.pos.append(pos)
        return len(self.pos) - 1

    def bits(self, which: int, rep: int) -> np.ndarray:
        """(positions, samples): 1 where bit s mod 32 of md5(seed:rep:key:s div 32:pos) keeps the position in sample s."""
        if rep not in self._kept:
            words = range((self.samples + 31) // 32)
            self._kept[rep] = [numbered([":".join([str(self.seed), str(rep), *p, str(c), ""]).encode() for p in self.parts], self.pos) for c in words]
        shift = np.arange(32, dtype=np.uint32)
        drawn = [(h[which][:, None] >> shift[: self.samples - 32 * c]) & np.uint32(1) for c, h in enumerate(self._kept[rep])]
        return np.concatenate(drawn, axis=1).astype(float)


class Explained:
    """One row (or perturbed copy) and its attributions, computed when asked for.

    Arrays over the positions: ``pos`` ascending, token ``codes``, ``labels`` (codes of the cleaned tokens), weights ``w``,
    ``local`` (numbers of the tokens among the ``n_local`` distinct ones of the row that was copied).  ``draws`` and ``which``: its samples."""

    def __init__(self, pos, codes, labels, w, mean, prior, local, n_local, draws, which):
        self.pos, self.codes, self.labels, self.w, self.mean, self.prior = pos, codes, labels, w, mean, prior
        self.draws, self.which = draws, which
        self.counts = np.bincount(local, minlength=n_local)
        self._occurrences = self.counts[local]
        self._kept: dict = {}

    def occurrences(self) -> np.ndarray:
        """Count of the position's token in the row."""
        return self._occurrences

    def score(self, method: str, rep: int = 0) -> np.ndarray:
        """Scores by position; only ``sampled`` differs between repetitions."""
        at = (method, rep if method == "sampled" else 0)
        if at not in self._kept:
            self._kept[at] = getattr(self, f"_{method}")(rep)
        return self._kept[at]

    def _ig(self, rep):
        norm = math.sqrt(float((self.w * self.w).sum()))
        return self.w / norm if norm > 0 else np.zeros(len(self.w))

    def _shap(self, rep):
        return self.w * (self.occurrences() - self.mean)

    def _occlusion(self, rep):
        return self.w * self.occurrences()

    def _sampled(self, rep):
        n = len(self.w)
        if self.prior is None:
            return np.zeros(n)
        bits = self.draws.bits(self.which, rep)
        sc, kept = self.prior + self.w @ bits, bits.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            effect = bits @ sc / kept - (1.0 - bits) @ sc / (bits.shape[1] - kept)
        effect[(kept == 0) | (kept == bits.shape[1])] = 0.0
        return effect - effect.sum() / n

    def ranked(self, method: str) -> np.ndarray:
        """Scores in descending order."""
        if ("ranked", method) not in self._kept:
            self._kept["ranked", method] = np.sort(self.score(method))[::-1]
        return self._kept["ranked", method]

    def top(self, method: str, frac: float) -> np.ndarray:
        """Distinct labels of the top max(1, int(frac·n)) positions, by score and then position."""
        order = np.argsort(-self.score(method), kind="stable")
        return np.unique(self.labels[order[: max(1, math.floor(len(order) * frac))]])


def _labels(names: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of each token's cleaned form (``T.strip_continuation``) and the names with the new forms at their end."""
    words = names.to_pylist()
    changed = {i: w.lstrip(" ").removeprefix("##") for i, w in enumerate(words) if w[:1] in (" ", "#")}
    label = np.arange(len(words))
    if not changed:
        return label, names
    known = {w: i for i, w in enumerate(words)}
    for i, w in changed.items():
        label[i] = known.setdefault(w, len(known))
    return label, pa.array(list(known), pa.string())


def measured(tw: DataFrame, key: list[str], prior: Column | None, fn, fields: list[StructField], samples: int = 16, seed=42) -> DataFrame:
    """(key…, fields…): ``fn(row, copies)`` gives tuples for every row of ``weighted_rows``, its ``Explained`` original
    and perturbed copies.  With copies their number (0 = original) is a part of the key that the samples are drawn from."""

    def kernel(b):
        off, pos_ = lists(b.column("pos"))
        _, tokens = lists(b.column("tokens"))
        _, words = lists(b.column("_vocab"))
        word, w, mean = (words.field(i) for i in range(3))
        enc = pa.concat_arrays([tokens, word]).dictionary_encode()
        every, pos, parts = enc.indices.to_numpy(), pos_.to_numpy(), b.column("_parts").to_pylist()
        codes, of = every[: len(tokens)], every[len(tokens) :]
        label, names = _labels(enc.dictionary)
        by_w, by_mean = np.zeros(len(enc.dictionary)), np.zeros(len(enc.dictionary))
        by_w[of], by_mean[of] = w.to_numpy(False), mean.to_numpy(False)
        d_off, d_ = lists(b.column("dropped"))
        c_off, c_ = lists(b.column("cuts"))
        gone, cuts, priors = d_.to_numpy(), c_.to_numpy(), b.column("_prior").to_pylist()

        def explained(draws, which, p, c, r, local, n_local):
            return Explained(p, c, label[c], by_w[c], by_mean[c], priors[r], local, n_local, draws, draws.add(which + parts[r], p))

        def records():
            for some in drawn_together(np.diff(off) * np.maximum(np.diff(c_off), 1)):
                draws, rows = Draws(samples, seed), []
                for r in some:
                    c, p = codes[off[r] : off[r + 1]], pos[off[r] : off[r + 1]]
                    cut, d = cuts[c_off[r] : c_off[r + 1]], gone[d_off[r] : d_off[r + 1]]
                    distinct, local = np.unique(c, return_inverse=True)
                    copies = []
                    for v in range(len(cut) - 1):
                        kept = np.ones(len(c), bool)
                        kept[d[cut[v] : cut[v + 1]]] = False
                        copies.append(explained(draws, [str(v + 1)], np.arange(int(kept.sum())), c[kept], r, local[kept], len(distinct)))
                    rows.append((r, explained(draws, ["0"] if copies else [], p, c, r, local, len(distinct)), copies))
                for r, row, copies in rows:
                    for t in fn(row, copies):
                        yield (r, *t)

        return records(), names

    rows = tw.withColumn("_parts", key_parts(key)).withColumn("_prior", (F.lit(0.0) if prior is None else prior).cast("double"))
    return map_rows(rows, key, ["pos", "tokens", "_vocab", "dropped", "cuts", "_parts", "_prior"], kernel, fields)


def weighted_rows(rows: DataFrame, key: list[str], weights: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Rows of ``with_words`` with ``_vocab``: the weight ``w`` (0 for unknown ones) and the mean count ``mean_x`` of
    each of their distinct tokens, over the explained rows and copies.  ``only``: the keys of the rows that are wanted."""
    each = rows.select(F.explode(F.arrays_zip("words", "n_all")).alias("_z")).select(F.col("_z.words").alias("token"), F.col("_z.n_all").alias("n"))
    n_rows = rows.agg(F.sum(F.size("cuts"))).scalar()
    means = each.groupBy("token").agg((F.sum("n") / n_rows).alias("mean_x"))
    known = means.join(weights, "token", "left").select("token", F.coalesce("w", F.lit(0.0)).alias("w"), "mean_x")
    rows = rows if only is None else rows.join(only, key, "left_semi")
    pairs = rows.select(*key, F.explode("words").alias("token")).join(known, "token")
    vocab = pairs.repartition(*key).groupBy(*key).agg(F.collect_list(F.struct("token", "w", "mean_x")).alias("_vocab"))
    return rows.select(*key, "pos", "tokens", "dropped", "cuts").join(vocab, key)


DOUBLE, STRING, INT = DoubleType(), StringType(), IntegerType()
