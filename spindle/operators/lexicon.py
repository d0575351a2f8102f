"""Unigram lexicon with a cost, and segmentation by models that are joined as tables (#89-91).

A model (merges, vocabulary, lexicon) may have any size: it is never collected.
The appliers of merges and WordPiece look up the substrings of every distinct
word; those found in the model come back to the word as its list of *edges*,
and a word is segmented from its own edges alone.

The learner and the Viterbi applier deal the distinct words into *blocks* of
about ``BLOCK_CHARS`` characters.  A block meets only the morphs that occur in
its words (its *parts*), each once however many places it has, and the edges
are made, weighed and summed up where the words lie: no edge is shuffled.

The learner
1. finds frequent substrings of any length by prefix doubling: a substring of
   length l in (s, 2s] can only be frequent if its first and last s characters
   are, so a round for s extends the places that are still alive;
2. alternates expectation (forward-backward over each word's edges, weighted
   by frequency) and maximisation until the corpus cost falls by less than a
   tolerance;
3. prunes by cost: a morph stays if spelling it with others would cost the
   corpus more than its letters cost the lexicon.  The cheapest losses go
   first, and so many that no more than ``n_types`` stay if a size is asked for.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util
from .util import bounded_broadcast, written

#: Characters of the words of a block, which one task holds with all their substrings.
BLOCK_CHARS = 250_000
#: Substrings up to this length are counted in the first round.
FIRST = 4
#: Words up to this length are weighed many at a time, as arrays of about so many edges; longer ones one by one.
ALIKE, CELLS = 64, 1_000_000
#: A lexicon up to so many rows goes to every block whole; of a larger one a block gets its parts.
WHOLE_LEXICON = 5_000


def _pieces_at(chars: Column, starts: Column, lengths: Callable[[Column], Column]) -> Column:
    """(start, piece) for the 1-based starts and the lengths that fit there, as one array per word."""
    piece = lambda i, n: F.struct(i.alias("start"), F.array_join(F.slice(chars, i, n), "").alias("piece"))
    return F.flatten(F.transform(starts, lambda i: F.transform(lengths(i), lambda n: piece(i, n))))


def _dealt(words: DataFrame) -> DataFrame:
    """``words`` (a written table) with the column ``block``; a word always lies in the same one."""
    chars = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    return words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(chars // BLOCK_CHARS + 1)))


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _per_block(words: DataFrame, parts: DataFrame, fn: Callable[[pa.Table, pa.Table], list], schema: str) -> DataFrame:
    """``fn(words, parts)`` of every block's rows: the columns of ``schema``."""
    out = _arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(fn(left, right), out, strict=True)], schema=out)

    parts = parts.withColumnRenamed("block", "_block")  # both sides may come from one table
    return words.groupBy("block").cogroup(parts.groupBy("_block")).applyInArrow(run, schema)


def _pieces_of(word: str, size: int, alive: set[str]) -> list[str]:
    """Substrings of lengths size + 1 to 2 * size whose first and last ``size`` characters are alive; size 0: all of up to FIRST."""
    n = len(word)
    if not size:
        return [word[i : i + m] for i in range(n) for m in range(1, min(FIRST, n - i) + 1)]
    at = [i for i in range(n - size + 1) if word[i : i + size] in alive]
    there = set(at)
    return [word[i : i + m] for i in at for m in range(size + 1, min(2 * size, n - i) + 1) if i + m - size in there]


def _substrings(words: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """Of ``words(word, freq, block)``, distinct: (morph, n) of the characters and frequent substrings, and their (block, morph)."""

    def counter(size: int) -> Callable[[pa.Table, pa.Table], list]:
        def fn(left: pa.Table, right: pa.Table) -> list:
            alive = set(right.column("morph").to_pylist())
            counts: dict[str, int] = {}  # occurrences << 32 | words
            for word, freq in zip(left.column("word").to_pylist(), left.column("freq").to_pylist(), strict=True):
                pieces = _pieces_of(word, size, alive)
                for piece in pieces:
                    counts[piece] = counts.get(piece, 0) + (freq << 32)
                for piece in set(pieces):
                    counts[piece] += 1
            block = left.column("block")[0].as_py() if left.num_rows else 0
            return [[block] * len(counts), list(counts), [x >> 32 for x in counts.values()], [x & 0xFFFFFFFF for x in counts.values()]]

        return fn

    found = parts = None
    size, alive = 0, words.select("block", F.col("word").alias("morph")).limit(0)
    while True:
        seen = written(_per_block(words.select("word", "freq", "block"), alive, counter(size), "block long, morph string, n long, words long"), "substrings-block")
        counts = seen.groupBy("morph").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
        counts = written(counts.where((F.char_length("morph") == 1) | ((F.col("n") >= min_count) & (F.col("words") > 1))).select("morph", "n"), "substrings")
        here = written(seen.join(_side(counts.select("morph")), "morph", "left_semi").select("block", "morph"), "substrings-parts")
        found = counts if found is None else found.unionByName(counts)
        parts = here if parts is None else parts.unionByName(here)
        size = 2 * size or FIRST
        alive = here.where(F.char_length("morph") == size)
        if alive.isEmpty():
            return found, parts


def _side(table: DataFrame) -> DataFrame:
    """A written table as the side of a join: broadcast up to util.BROADCAST_ROWS rows."""
    return bounded_broadcast(table, util.BROADCAST_ROWS) or table


def _distinct_words(wf: DataFrame) -> DataFrame:
    """(word, freq, block) of ``wf(word, freq)``, written; a word that comes twice once."""
    rows = wf.where(F.length("word") > 0).groupBy("word").agg(F.sum("freq").cast("long").alias("freq"))
    return _dealt(written(rows, "lexicon-words"))


def frequent_substrings(wf: DataFrame, min_count: int = 2) -> DataFrame:
    """(morph, n): substrings of two characters or more that occur ``min_count`` times or more, in two distinct words at least."""
    return _substrings(_distinct_words(wf), min_count)[0].where(F.char_length("morph") > 1)


def edges(words: DataFrame, keys: DataFrame, continuation: str = "") -> DataFrame:
    """(word, start, length, key) for every place of a distinct word where a key of ``keys(key)`` stands.

    ``continuation`` is put before pieces inside a word when they are looked up.
    """
    plain = F.when(F.startswith("key", F.lit(continuation)), F.substring("key", len(continuation) + 1, 1 << 30)).otherwise(F.col("key")) if continuation else F.col("key")
    lengths = sorted(r[0] for r in keys.select(F.char_length(plain)).distinct().collect() if r[0])  # as many as the longest key has characters
    if not lengths:
        return words.select("word", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("key")).limit(0)
    chars = words.select("word", F.filter(F.split("word", ""), lambda c: c != "").alias("chars")).where(F.size("chars") > 0)
    fits = lambda i: F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: i + n - 1 <= F.size("chars"))
    rows = chars.select("word", F.explode(_pieces_at(F.col("chars"), F.sequence(F.lit(1), F.size("chars")), fits)).alias("p"))
    looked = F.when(F.col("p.start") > 1, F.concat(F.lit(continuation), "p.piece")).otherwise(F.col("p.piece")) if continuation else F.col("p.piece")
    rows = rows.select("word", (F.col("p.start") - 1).alias("start"), F.char_length("p.piece").alias("length"), looked.alias("key"))
    return rows.join(keys.select("key").distinct(), "key", "left_semi").select("word", "start", "length", "key")


def _per_word(rows: DataFrame, fields: list[str], schema: str, fn: Callable[..., list[tuple]], extra: list[Column] = (), add: bool = False) -> DataFrame:
    """``fn(word, edges, *extra)`` of every word's edges (tuples of ``fields``), its results as rows of ``schema``.

    ``add``: the results are pairs of a key and a number, which are summed up by key batch by batch.
    """
    grouped = rows.groupBy("word").agg(F.collect_list(F.struct(*fields)).alias("edges"), *extra)
    out = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            places = b.column(1).offsets.to_pylist()
            found = list(zip(*(x.to_pylist() for x in b.column(1).flatten().flatten()), strict=True))
            offset = places[0]
            words, *others = (b.column(i).to_pylist() for i in range(b.num_columns) if i != 1)
            for i, word in enumerate(words):
                made += fn(word, found[places[i] - offset : places[i + 1] - offset], *(x[i] for x in others))
            if add:
                sums: dict = {}
                for key, x in made:
                    sums[key] = sums.get(key, 0.0) + x
                made = list(sums.items())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    return grouped.mapInArrow(run, schema)


def _log_add(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def expectation(n: int, found: list[tuple[int, int, str, float]]) -> tuple[dict[str, float], float]:
    """Expected number of each morph in a word of n characters, and its cost, from edges (start, length, morph, cost)."""
    ends: list[list] = [[] for _ in range(n + 1)]
    starts: list[list] = [[] for _ in range(n + 1)]
    for start, length, morph, cost in found:
        ends[start + length].append((start, cost))
        starts[start].append((start + length, cost))
    forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for j in range(1, n + 1):
        if xs := [forward[i] - c for i, c in ends[j] if forward[i] > -math.inf]:
            forward[j] = _log_add(xs)
    for i in range(n - 1, -1, -1):
        if xs := [backward[j] - c for j, c in starts[i] if backward[j] > -math.inf]:
            backward[i] = _log_add(xs)
    out: dict[str, float] = {}
    for start, length, morph, cost in found:
        x = forward[start] - cost + backward[start + length] - forward[n]
        if x > -700:
            out[morph] = out.get(morph, 0.0) + math.exp(x)
    return out, -forward[n]


def best_path(n: int, found: list[tuple[int, int, str, float]]) -> tuple[list[str], float]:
    """Cheapest segmentation from edges (start, length, morph, cost); ties to the shorter last piece, then to the smaller one."""
    ends: list[list] = [[] for _ in range(n + 1)]
    for start, length, morph, cost in found:
        ends[start + length].append((start, morph, cost))
    best, back = [0.0] + [math.inf] * n, [None] * (n + 1)
    for j in range(1, n + 1):
        for start, morph, cost in sorted(ends[j], key=lambda e: (-e[0], e[1])):
            if best[start] + cost < best[j]:
                best[j], back[j] = best[start] + cost, (start, morph)
    pieces, j = [], n
    while j and back[j]:
        j, morph = back[j]
        pieces.append(morph)
    return pieces[::-1], best[n]


def expected_counts(graph: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(morph, expected): sums over the words of ``graph(word, freq, start, length, morph)``; the row with a null morph is the corpus cost."""

    def fn(word, found, freq):
        counts, cost = expectation(len(word), found)
        return [(m, freq * x) for m, x in counts.items()] + [(None, freq * cost)]

    rows = graph.join(lexicon.select("morph", "cost"), "morph")
    sums = _per_word(rows, ["start", "length", "morph", "cost"], "morph string, expected double", fn, [F.first("freq").alias("freq")], add=True)
    return sums.groupBy("morph").agg(F.sum("expected").alias("expected"))


def _log_sum(xs: np.ndarray) -> np.ndarray:
    """Logarithm of the sums of exp over the first axis."""
    top = xs.max(axis=0)
    top[np.isneginf(top)] = 0.0
    return top + np.log(np.exp(xs - top).sum(axis=0))


def _expect_alike(words: list[str], freq: np.ndarray, morphs: pa.Array, cost: np.ndarray, lengths: list[int], sums: np.ndarray) -> float:
    """``expectation`` of words of one length at once, added to ``sums``; returns their cost.  The last entry of ``cost`` is infinite: no morph."""
    n, w = len(words[0]), pa.array(words)
    row = {e: k for k, e in enumerate((i, m) for m in lengths if m <= n for i in range(n - m + 1))}
    forward, backward = np.full((n + 1, len(words)), -np.inf), np.full((n + 1, len(words)), -np.inf)
    forward[0] = backward[n] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        if row:
            ids = pc.index_in(pa.concat_arrays([pc.utf8_slice_codeunits(w, i, i + m) for i, m in row]), value_set=morphs)
            ids = ids.fill_null(len(morphs)).to_numpy(zero_copy_only=False).reshape(len(row), len(words))
            price = cost[ids]
            for j in range(1, n + 1):
                if at := [(j - m, row[j - m, m]) for m in lengths if m <= j]:
                    forward[j] = _log_sum(forward[[i for i, _ in at]] - price[[k for _, k in at]])
            for i in range(n - 1, -1, -1):
                if at := [(i + m, row[i, m]) for m in lengths if m <= n - i]:
                    backward[i] = _log_sum(backward[[j for j, _ in at]] - price[[k for _, k in at]])
            edge, word = np.nonzero(ids < len(morphs))
            start, end = (np.array(x)[edge] for x in zip(*((i, i + m) for i, m in row), strict=True))
            x = forward[start, word] - price[edge, word] + backward[end, word] - forward[n, word]
            sums += np.bincount(ids[edge, word], np.where(x > -700, np.exp(x), 0.0) * freq[word], len(sums))
    return float(-(freq * forward[n]).sum())


def _edges_of(word: str, at: dict, lengths: list[int]) -> list[tuple[int, int, str]]:
    """(start, length, morph) for every place of the word where a key of ``at`` stands."""
    n = len(word)
    return [(i, m, word[i : i + m]) for i in range(n) for m in lengths if i + m <= n and word[i : i + m] in at]


def _expected_in_block(left: pa.Table, right: pa.Table) -> list:
    morphs, cost = right.column("morph").to_pylist(), np.append(right.column("cost").to_numpy(), np.inf)
    at, known = {m: i for i, m in enumerate(morphs)}, pa.array(morphs, pa.string())
    lengths = sorted({len(m) for m in morphs})
    alike: dict[int, list] = {}
    for word, freq in zip(left.column("word").to_pylist(), left.column("freq").to_pylist(), strict=True):
        alike.setdefault(len(word), []).append((word, freq))
    sums, total = np.zeros(len(cost)), 0.0
    for n, rows in alike.items():
        if n > ALIKE:
            for word, freq in rows:
                counts, x = expectation(n, [(i, m, p, cost[at[p]]) for i, m, p in _edges_of(word, at, lengths)])
                total += freq * x
                for p, y in counts.items():
                    sums[at[p]] += freq * y
            continue
        step = max(1, CELLS // max(1, sum(n - m + 1 for m in lengths if m <= n)))
        for k in range(0, len(rows), step):
            words, freq = zip(*rows[k : k + step], strict=True)
            total += _expect_alike(words, np.array(freq, float), known, cost, lengths, sums)
    some = np.flatnonzero(sums[:-1] > 0)
    return [[morphs[i] for i in some] + [None], [*sums[some].tolist(), total]]


def expected_in_blocks(graph: tuple[DataFrame, DataFrame], lexicon: DataFrame) -> DataFrame:
    """``expected_counts`` where the graph is ``words(word, freq, block)`` and their ``parts(block, morph)``."""
    words, parts = graph
    priced = parts.select("block", "morph").join(_side(lexicon.select("morph", "cost")), "morph")
    sums = _per_block(words.select("word", "freq", "block"), priced, _expected_in_block, "morph string, expected double")
    return sums.groupBy("morph").agg(F.sum("expected").alias("expected"))


def _with_cost(counts: DataFrame, count: str) -> DataFrame:
    """Costs -log p from counts."""
    total = counts.agg(F.sum(count).alias("t"))
    return counts.select("morph", F.col(count).cast("double").alias("count")).withColumn("cost", F.log(total.scalar()) - F.log(F.col("count")))


def converge(graph, lexicon: DataFrame, tolerance: float, counts: Callable = expected_counts) -> tuple[DataFrame, float]:
    """Expectation and maximisation until the corpus cost falls by a smaller share than ``tolerance``: (lexicon(morph, count, cost), cost)."""
    before = math.inf
    while True:
        sums = written(counts(graph, lexicon), "lexicon-counts")
        cost = sums.where("morph IS NULL").first()["expected"]
        lexicon = written(_with_cost(sums.where("morph IS NOT NULL AND expected > 0"), "expected"), "lexicon")
        if before - cost <= tolerance * cost:
            return lexicon, cost
        before = cost


def losses(lexicon: DataFrame, parts: DataFrame) -> DataFrame:
    """(morph, net): for morphs of two characters or more, what the corpus would lose without them less what their letters cost.

    ``parts(block, morph, home)``: a morph is spelled with others in its home block, whose parts are all that occur in it.
    """
    letters = lexicon.where(F.char_length("morph") == 1).count() + 1
    multi = lexicon.where(F.char_length("morph") > 1)
    out = _arrow_schema(schema := "morph string, other double")

    def spelled(rows: pa.Table) -> pa.Table:
        morphs = rows.column("morph").to_pylist()
        cost = dict(zip(morphs, rows.column("cost").to_pylist(), strict=True))
        lengths = sorted({len(m) for m in morphs})
        made = []
        for word, home in zip(morphs, rows.column("home").to_pylist(), strict=True):
            if home and len(word) > 1 and (found := [(i, n, m, cost[m]) for i, n, m in _edges_of(word, cost, lengths) if n < len(word)]):
                made.append((word, best_path(len(word), found)[1]))
        return pa.Table.from_arrays([pa.array([x[k] for x in made], f.type) for k, f in enumerate(out)], schema=out)

    priced = parts.join(_side(lexicon.select("morph", "cost")), "morph").select("block", "morph", "home", "cost")
    other = priced.groupBy("block").applyInArrow(spelled, schema)
    net = F.col("count") * (F.col("other") - F.col("cost")) - (F.char_length("morph") + 1) * F.lit(math.log(letters))
    return multi.join(other, "morph").select("morph", net.alias("net"))


def learn_unigram_lexicon(spark: SparkSession, wf: DataFrame, n_types: int | None = None, min_count: int = 2, tolerance: float = 1e-3, share: float = 0.75) -> DataFrame:
    """#88: lexicon(morph, count, cost) of ``wf(word, freq)``.

    Single characters always stay.  A round prunes at most ``share`` of the
    other morphs, those of the smallest net loss: all that cost more than they
    save, and further ones while more than ``n_types`` are left.
    """
    words = _distinct_words(wf)
    whole = words.where((F.char_length("word") > 1) & (F.col("freq") >= min_count)).select("block", F.col("word").alias("morph"), F.col("freq").alias("n"))
    seeds, parts = _substrings(words, min_count)
    lexicon = written(_with_cost(seeds.unionByName(whole.select("morph", "n")).groupBy("morph").agg(F.max("n").alias("n")), "n"), "lexicon")
    # A frequent whole word that is no frequent substring stands in itself alone.
    parts = parts.unionByName(whole.select("block", "morph")).distinct()
    home = parts.groupBy("morph").agg(F.min("block").alias("_home"))
    parts = written(parts.join(home, "morph").select("block", "morph", (F.col("block") == F.col("_home")).alias("home")), "lexicon-parts")
    while True:
        lexicon, _ = converge((words, parts), lexicon, tolerance, expected_in_blocks)
        net = written(losses(lexicon, parts), "lexicon-losses")
        n = net.count()
        useless = net.where("net < 0").count()
        drop = min(max(useless, n - n_types if n_types is not None else 0), max(1, int(share * n)))
        if not drop or not n:
            return lexicon
        gone = net.orderBy("net", "morph").limit(drop).select("morph")
        lexicon = written(lexicon.join(gone, "morph", "left_anti"), "lexicon")
        parts = written(parts.join(_side(lexicon.select("morph")), "morph", "left_semi"), "lexicon-parts")


# ---------------------------------------------------------------------------
# Appliers
# ---------------------------------------------------------------------------

def merge_word(word: str, ranks: dict[tuple[str, str], int], continuation: bool = False) -> list[str]:
    """Apply merges to one word: the lowest-ranked adjacent pair first, equal ones from the left."""
    symbols = [c if not i or not continuation else "##" + c for i, c in enumerate(word)]
    before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    rank = lambda i, j: ranks.get((symbols[i], symbols[j]))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(len(symbols) - 1) if (r := rank(i, i + 1)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue  # merged meanwhile
        symbols[i] = left + (right[2:] if continuation and right.startswith("##") else right)
        symbols[j] = None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (r := rank(x, y)) is not None:
                heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
    return [s for s in symbols if s is not None]


def longest_match(word: str, found: list[tuple[int, int, str]], unk: str = "[UNK]") -> list[str]:
    """Greedy longest pieces from the left, from edges (start, length, piece); a word with a rest is unknown."""
    longest: dict[int, tuple[int, str]] = {}
    for start, length, piece in found:
        longest[start] = max(longest.get(start, (0, "")), (length, piece))
    out, at = [], 0
    while at < len(word):
        if at not in longest:
            return [unk]
        length, piece = longest[at]
        out.append(piece)
        at += length
    return out


def _segmented(tok: DataFrame, rows: DataFrame, fields: list[str], fn: Callable[[str, list[tuple]], list[str]]) -> DataFrame:
    """``tok`` with the column ``pieces``; words without an edge are segmented from none."""
    schema = "token string, pieces array<string>"
    cut = _per_word(rows, fields, schema, lambda word, found: [(word, fn(word, [e for e in found if e[0] is not None]))])
    return tok.join(cut, "token")


def _words(tok: DataFrame) -> DataFrame:
    return tok.select(F.col("token").alias("word")).where(F.length("token") > 0).distinct()


def apply_merges(tok: DataFrame, merges: DataFrame, continuation: bool = False) -> DataFrame:
    """#89: BPE pieces by ``merges(rank, left, right)`` for each token of ``tok(..., token)`` → adds ``pieces``.  A word meets the merges whose result stands in it."""
    words = _words(tok)
    ends = [F.regexp_replace(c, "^##", "") if continuation else F.col(c) for c in ("left", "right")]
    model = merges.select(F.concat(*ends).alias("key"), F.struct("left", "right", "rank").alias("merge"))
    found = edges(words, model.select("key")).select("word", "key").distinct().join(model, "key")
    rows = words.join(found, "word", "left").select("word", "merge.left", "merge.right", "merge.rank")
    return _segmented(tok, rows, ["left", "right", "rank"], lambda word, found: merge_word(word, {(a, b): r for a, b, r in found}, continuation))


def apply_wordpiece(tok: DataFrame, vocab: DataFrame) -> DataFrame:
    """#90: WordPiece pieces for each token."""
    words = _words(tok)
    rows = words.join(edges(words, vocab.select(F.col("token").alias("key")), "##"), "word", "left").select("word", "start", "length", "key")
    return _segmented(tok, rows, ["start", "length", "key"], longest_match)


#: What a character outside the lexicon costs above its dearest morph.
UNKNOWN_COST = 10.0


def _priced_parts(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(block, morph, cost): all of a small lexicon for every block, of a larger one what occurs in the block's words."""
    lexicon = written(lexicon.where(F.col("morph").isNotNull()).groupBy("morph").agg(F.min("cost").alias("cost")), "lexicon")
    if (small := bounded_broadcast(lexicon, WHOLE_LEXICON)) is not None:
        return words.select("block").distinct().crossJoin(small)
    lengths = sorted(r[0] for r in lexicon.select(F.char_length("morph")).distinct().collect())

    def pieces(left: pa.Table, _: pa.Table) -> list:
        found = {w[i : i + m] for w in left.column("word").to_pylist() for m in lengths for i in range(len(w) - m + 1)}
        return [[left.column("block")[0].as_py()] * len(found), list(found)]

    none = words.select("block").limit(0)
    return _per_block(words, none, pieces, "block long, morph string").join(_side(lexicon), "morph").select("block", "morph", "cost")


def apply_viterbi(tok: DataFrame, lexicon: DataFrame) -> DataFrame:
    """#91: lowest-cost segmentation of each token under ``lexicon(morph, cost)``; other characters are pieces at a high cost."""
    words = _dealt(written(_words(tok), "lexicon-words"))
    unknown = (lexicon.agg(F.coalesce(F.max("cost"), F.lit(0.0)).alias("c")).first()["c"]) + UNKNOWN_COST

    def cut(left: pa.Table, right: pa.Table) -> list:
        cost = dict(zip(right.column("morph").to_pylist(), right.column("cost").to_pylist(), strict=True))
        lengths = sorted({len(m) for m in cost} - {0})
        words, pieces = left.column("word").to_pylist(), []
        for word in words:
            found = [(i, n, m, cost[m]) for i, n, m in _edges_of(word, cost, lengths)]
            found += [(i, 1, c, unknown) for i, c in enumerate(word) if c not in cost]
            pieces.append(best_path(len(word), found)[0])
        return [words, pieces]

    return tok.join(_per_block(words, _priced_parts(words, lexicon), cut, "token string, pieces array<string>"), "token")
