"""Merge learners: BPE, SPE and WordPiece, several merges a round.

State is two tables: the distinct words (or lines) as symbol sequences, and
the frequency of every pair of neighbouring symbols.  A round

1. takes the ``CANDIDATES`` most frequent pairs and the frequencies of the
   triples made of two of them (at most CANDIDATES squared, map-side combined);
2. decides on the driver which merges a learner that takes one at a time would
   make next (``next_merges``): it goes on as long as the next pair's frequency
   is known exactly and no pair whose frequency is only bounded could precede it;
3. merges them in the words, and changes the pair table by the difference of
   the words that changed.  Words without one of the pairs take no part in any
   shuffle.

The merges are those of the plain learner, in its order.  Both tables are kept
between rounds and cut from their lineage by a reliable checkpoint every few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .rowwise import lists
from .util import cut_lineage

#: Between the symbols of a sequence; symbols may hold blanks, so whole lines can be learned from.
SEP = "\u0001"
#: Pairs that a round looks at, and merges that it makes at most.
CANDIDATES, ROUND = 1000, 50


def word_freq(tok: DataFrame, token: str = "token") -> DataFrame:
    """(word, freq) from a tokens table; a text's own separator characters are left out."""
    return tok.groupBy(F.translate(F.col(token), SEP, "").alias("word")).agg(F.count(F.lit(1)).alias("freq"))


def line_freq(rows: DataFrame, text: str = "text") -> DataFrame:
    """(word, freq) of whole lines, blanks included: the input of a learner without words."""
    lines = rows.select(F.explode(F.split(F.col(text), "\n")).alias("token")).where(F.length("token") > 0)
    return word_freq(lines)


def char_symbols(word: Column, continuation: bool = False) -> Column:
    chars = F.filter(F.split(word, ""), lambda c: F.length(c) > 0)
    if continuation:
        chars = F.transform(chars, lambda c, i: F.when(i > 0, F.concat(F.lit("##"), c)).otherwise(c))
    return F.array_join(chars, SEP)


def _neighbours(symbols: Column, k: int) -> Column:
    """All runs of ``k`` neighbouring symbols as structs s0, s1, ..."""
    n = F.greatest(F.size(symbols) - k + 1, F.lit(0))
    return F.arrays_zip(*[F.slice(symbols, i + 1, n).alias(f"s{i}") for i in range(k)])


#: Different runs that a task holds before it hands on their counts.
HELD = 500_000


def _runs(seqs: pa.Array, k: int, known: dict[tuple[str, str], int] | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Runs of ``k`` (2 or 3) neighbouring symbols, as rows of codes, the sequence of each, and the symbols by code.

    ``known``: only runs whose pairs are all among these."""
    off, values = lists(pc.split_pattern(seqs, SEP))
    enc = values.dictionary_encode()
    names = enc.dictionary.to_pylist()
    codes, row = enc.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(seqs)), np.diff(off))
    at = np.flatnonzero(row[1:] == row[:-1])
    if known is not None:
        code = {x: i for i, x in enumerate(names)}
        pairs = np.array(sorted(code[a] * len(names) + code[b] for a, b in known if a in code and b in code), np.int64)
        is_known = np.zeros(len(codes), bool)
        is_known[at] = np.isin(codes[at] * len(names) + codes[at + 1], pairs)
        at = np.flatnonzero(is_known)
    if k == 3:
        at = at[:-1][np.diff(at) == 1]
        at = at[row[at] == row[np.minimum(at + 2, len(row) - 1)]]
    return np.stack([codes[at + i] for i in range(k)], axis=1), row[at], names


def _summed(runs: np.ndarray, n: np.ndarray, names: list[str], sums: dict) -> None:
    """Adds the numbers ``n`` of equal runs to ``sums``."""
    if not len(runs):
        return
    key = np.zeros(len(runs), np.int64)
    for i in range(runs.shape[1]):  # numbered anew from part to part: never more than runs x symbols
        _, key = np.unique(key * len(names) + runs[:, i], return_inverse=True)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    for run, x in zip(runs[order[first]].tolist(), np.add.reduceat(n[order], first).tolist(), strict=True):
        if x:
            run = tuple([names[c] for c in run])
            sums[run] = sums.get(run, 0) + x


def _run_counts(rows: DataFrame, sides: dict[str, int], k: int, known: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """(s0, s1, ..., n): how often each run of ``k`` symbols stands in the sequences, weighted by ``freq`` and the sign of each column of ``sides``.

    Counted where the rows lie; what is shuffled are the sums of each task."""
    ship_package(rows.sparkSession)
    columns = [f"s{i}" for i in range(k)]

    def out(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*zip(*sums, strict=True), sums.values()], [pa.string()] * k + [pa.int64()], strict=True)], names=[*columns, "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            freq = b.column(0).to_numpy()
            for i, sign in enumerate(sides.values(), 1):
                runs, row, names = _runs(b.column(i), k, known)
                _summed(runs, sign * freq[row], names, sums)
            if len(sums) > HELD:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    schema = ", ".join(f"{c} string" for c in columns) + ", n bigint"
    each = rows.select("freq", *sides).mapInArrow(count, schema)
    return each.groupBy(*columns).agg(F.sum("n").cast("bigint").alias("n"))


def pair_counts(wf: DataFrame, seq: str | None = None) -> DataFrame:
    """#84: adjacent-symbol pair frequencies weighted by word frequency.

    ``wf(word, freq[, seq])``; without ``seq`` the symbols are the characters.
    """
    if seq:
        return _run_counts(wf, {seq: 1}, 2).select(F.col("s0").alias("left"), F.col("s1").alias("right"), "n")
    pairs = wf.select("freq", F.explode(_neighbours(F.filter(F.split("word", ""), lambda c: F.length(c) > 0), 2)).alias("p"))
    return pairs.groupBy(F.col("p.s0").alias("left"), F.col("p.s1").alias("right")).agg(F.sum("freq").cast("bigint").alias("n"))


def merged_symbol(left: str, right: str, continuation: bool = False) -> str:
    return left + (right[2:] if continuation and right.startswith("##") else right)


class _Counts:
    """Frequencies of pairs while merges are decided: exact ones and upper bounds."""

    def __init__(self, top: list[tuple[str, str, int]], triples: dict[tuple[str, str, str], int]) -> None:
        self.n = {(a, b): n for a, b, n in top}
        self.exact = set(self.n)
        self.triples = triples
        self.made: set[str] = set()
        # A triple is only an upper bound once its first symbol may have been merged with what precedes it, or its
        # last one with what follows.
        self.first_gone, self.last_gone = set(), set()
        self.by_left: dict[str, set] = {}
        self.by_right: dict[str, set] = {}
        for a, b in self.n:
            self._index(a, b)

    def _index(self, a: str, b: str) -> None:
        self.by_left.setdefault(a, set()).add(b)
        self.by_right.setdefault(b, set()).add(a)

    def best(self) -> tuple[str, str] | None:
        return min(self.n, key=lambda p: (-self.n[p], p)) if self.n else None

    def _triple(self, x: str, y: str, z: str) -> int | None:
        """Its frequency, None if it isn't known."""
        if self.made & {x, y, z} or x in self.first_gone or z in self.last_gone:
            return None
        return self.triples.get((x, y, z), 0)

    def _set(self, pair: tuple[str, str], n: int, exact: bool) -> None:
        self.n[pair] = n
        self._index(*pair)
        (self.exact.add if exact else self.exact.discard)(pair)

    def merge(self, a: str, b: str, ab: str) -> None:
        n = self.n.pop((a, b))
        self.exact.discard((a, b))
        self.by_left[a].discard(b)
        self.by_right[b].discard(a)
        for x in list(self.by_right.get(a, ())):  # x a b -> x ab
            self._moved((x, a), (x, ab), self._triple(x, a, b) if x != b else None, n)
        for y in list(self.by_left.get(b, ())):  # a b y -> ab y
            self._moved((b, y), (ab, y), self._triple(a, b, y) if y != a else None, n)
        if a in self.by_left.get(b, ()):
            self._set((ab, ab), min(n, self.n[b, a]), False)
        self.first_gone.add(b)
        self.last_gone.add(a)
        self.made.add(ab)

    def _moved(self, old: tuple[str, str], new: tuple[str, str], n: int | None, most: int) -> None:
        """``n`` occurrences of ``old`` became ``new``; None: some of them, ``most`` at most."""
        if n is None:
            self._set(new, min(self.n[old], most), False)
            self._set(old, self.n[old], False)
        else:
            exact = old in self.exact
            self._set(new, min(n, self.n[old]), True)
            self._set(old, self.n[old] - n, exact)


def next_merges(
    top: list[tuple[str, str, int]], more: bool, triples: dict[tuple[str, str, str], int], limit: int, least: int,
    join: Callable[[str, str], str], taken: Callable[[str], bool],
) -> list[tuple[str, str, str, int]]:
    """The next merges (left, right, merged, n) of a learner that takes the most frequent pair each time, ties to the
    smaller pair: as many as follow from these frequencies, one at least.

    ``top``: the most frequent pairs, ``more``: there are others (none more frequent than the last of ``top``).
    ``taken``: whether a merged symbol already stands in the words; its pairs would grow.
    """
    counts, out = _Counts(top, triples), []
    floor = top[-1][2] if more and top else 0
    while len(out) < limit and (best := counts.best()) is not None:
        n = counts.n[best]
        if n < least or (out and (n <= floor or best not in counts.exact)):
            break
        a, b = best
        ab = join(a, b)
        out.append((a, b, ab, n))
        # Runs of one symbol, and symbols that were there before, need new counts.
        if a == b or ab in counts.made or taken(ab):
            break
        counts.merge(a, b, ab)
    return out


def _java_quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _java_replacement(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def _merged_seq(seq: Column, batch: list[tuple[str, str, str, int]]) -> Column:
    """The sequence after the merges of ``batch``, one after the other; words without one of the pairs are left alone."""
    # every symbol between two separators of its own: a pair is then found as plain text, from the left
    plain = all(left and right for left, right, *_ in batch)
    after = F.concat(F.lit(SEP), F.replace(seq, F.lit(SEP), F.lit(SEP + SEP)), F.lit(SEP)) if plain else seq
    for left, right, merged, _ in batch:
        if plain:
            after = F.replace(after, F.lit(SEP + left + SEP + SEP + right + SEP), F.lit(SEP + merged + SEP))
        else:
            pattern = f"(?<![^{SEP}])" + _java_quote(left) + SEP + _java_quote(right) + f"(?![^{SEP}])"
            after = F.regexp_replace(after, F.lit(pattern), F.lit(_java_replacement(merged)))
    if plain:
        after = F.replace(F.substring(after, 2, 1 << 30), F.lit(SEP + SEP), F.lit(SEP))
        after = F.left(after, F.char_length(after) - 1)
    new = {m[2] for m in batch}  # a pair with one of these comes from another pair of the batch
    touched = [F.contains(seq, F.lit(left + SEP + right)) for left, right, *_ in batch if not new & {left, right}]
    return F.when(reduce(Column.__or__, touched), after).otherwise(seq)


def learn_merges(
    spark: SparkSession,
    wf: DataFrame,
    n_merges: int,
    min_frequency: int = 2,
    continuation: bool = False,
    initial_seq: Column | None = None,
    checkpoint_every: int = 5,
    candidates: int = CANDIDATES,
) -> tuple[DataFrame, DataFrame]:
    """#85 BPE / #86 SPE / #87 WordPiece merge learning.

    Returns ``merges(rank, left, right, merged, n)`` and the final
    ``words(word, freq, seq)``.  Ties break by (count desc, left, right).
    Stops early when the best pair occurs fewer than ``min_frequency`` times.
    """
    seq0 = initial_seq if initial_seq is not None else char_symbols(F.col("word"), continuation)
    words = cut_lineage(wf.select("word", "freq", seq0.alias("seq")).where(F.length("seq") > 0)).persist()
    counts = pair_counts(words, "seq").persist()
    # Symbols of several characters that stand in the words from the start (atoms, not characters).
    long_symbol = F.length(F.regexp_replace("s", "^##", "") if continuation else F.col("s")) > 1
    atoms = words.select(F.explode(F.split("seq", SEP)).alias("s")).where(long_symbol).distinct() if initial_seq is not None else None
    made: set[str] = set()
    merges: list[tuple[str, str, str, int]] = []
    rounds = 0
    while len(merges) < n_merges:
        rows = counts.orderBy(F.col("n").desc(), "left", "right").limit(candidates + 1).collect()
        top = [(r["left"], r["right"], int(r["n"])) for r in rows[:candidates]]
        if not top or top[0][2] < min_frequency:
            break
        joined = {merged_symbol(a, b, continuation) for a, b, _ in top}
        there = made if atoms is None else made | {r["s"] for r in atoms.where(F.col("s").isin(list(joined))).collect()}
        batch = next_merges(
            top, len(rows) > candidates, _triples(spark, words, top), min(ROUND, n_merges - len(merges)), min_frequency,
            lambda a, b: merged_symbol(a, b, continuation), lambda s, there=there, joined=joined: s in there or (atoms is not None and s not in joined),
        )
        if not batch:
            break
        merges += batch
        made |= {m[2] for m in batch}
        rounds += 1
        after = _merged_seq(F.col("seq"), batch)
        both = words.select("word", "freq", F.col("seq").alias("before"), after.alias("seq")).persist()  # read by both new tables
        delta = _run_counts(both.where(F.col("seq") != F.col("before")), {"seq": 1, "before": -1}, 2).select(F.col("s0").alias("left"), F.col("s1").alias("right"), "n")
        grown = counts.unionByName(delta).groupBy("left", "right").agg(F.sum("n").cast("bigint").alias("n")).where("n > 0")
        new_words, new_counts = both.select("word", "freq", "seq"), grown
        if rounds % checkpoint_every == 0:
            new_words = cut_lineage(new_words)
        new_words = new_words.persist()
        new_counts = (cut_lineage(new_counts) if rounds % checkpoint_every == 0 else new_counts).persist()
        new_words.count(), new_counts.count()  # both are read from the old tables, which go now
        for old in (counts, words, both):
            old.unpersist()
        words, counts = new_words, new_counts
    counts.unpersist()
    rows = [(i + 1, *m) for i, m in enumerate(merges)]
    return spark.createDataFrame(rows, "rank int, left string, right string, merged string, n bigint"), words


def _triples(spark: SparkSession, words: DataFrame, top: list[tuple[str, str, int]]) -> dict[tuple[str, str, str], int]:
    """Frequencies of the triples whose two pairs are both among ``top`` (a bounded list)."""
    runs = _run_counts(words, {"seq": 1}, 3, {(a, b): n for a, b, n in top})
    return {tuple(r)[:3]: int(r["n"]) for r in runs.collect()}


def vocabulary(words: DataFrame, merges: DataFrame, initial: DataFrame, specials: tuple[str, ...] = ()) -> DataFrame:
    """(token, tier, place): special tokens, then the initial symbols, then merged symbols by rank, each once at its first place."""
    spark = words.sparkSession
    parts = initial.select("token", F.lit(1).alias("tier"), F.lit(0).alias("place"))
    parts = parts.unionByName(merges.select(F.col("merged").alias("token"), F.lit(2).alias("tier"), F.col("rank").alias("place")))
    if specials:
        parts = parts.unionByName(spark.createDataFrame([(s, 0, i) for i, s in enumerate(specials)], "token string, tier int, place int"))
    return parts.groupBy("token").agg(F.min(F.struct("tier", "place")).alias("_k")).select("token", "_k.tier", "_k.place")


def symbols(wf: DataFrame, seq: Column) -> DataFrame:
    """The distinct initial symbols."""
    return wf.select(F.explode(F.split(seq, SEP)).alias("token")).where(F.length("token") > 0).distinct()


def learn_to_size(
    spark: SparkSession, wf: DataFrame, vocab_size: int, min_frequency: int = 2, continuation: bool = False, specials: tuple[str, ...] = (), seq: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """#85-87 to a vocabulary of ``vocab_size``: special tokens and initial symbols count, merges fill the rest.

    Returns the merges and the vocabulary(token, tier, place).
    """
    start = seq if seq is not None else char_symbols(F.col("word"), continuation)
    wf = cut_lineage(wf)  # read by the symbols and the learner
    first = symbols(wf, start)
    room = max(0, vocab_size - len(specials) - first.count())
    merges, words = learn_merges(spark, wf, room, min_frequency, continuation, seq)
    return merges, vocabulary(words, merges, first, specials)


def atom_freq(rows: DataFrame, tokens: Column) -> DataFrame:
    """(word, freq) of whole rows of atom tokens, a word being the row's tokens."""
    toks = rows.select(tokens.alias("t")).where(F.size("t") > 0)
    clean = F.transform("t", lambda x: F.translate(x, SEP, ""))
    return toks.select(F.array_join(clean, SEP).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def learn_spe(spark: SparkSession, rows: DataFrame, tokens_col: Column, vocab_size: int, min_frequency: int = 2, total_symbols: bool = True):
    """#86: merges over atom tokens of whole rows.

    With ``total_symbols`` the initial distinct symbols count against the
    budget: merges = vocab_size − #symbols.
    """
    wf = cut_lineage(atom_freq(rows, tokens_col))
    n_symbols = symbols(wf, F.col("word")).count() if total_symbols else 0
    return learn_merges(spark, wf, max(0, vocab_size - n_symbols), min_frequency, initial_seq=F.col("word"))
