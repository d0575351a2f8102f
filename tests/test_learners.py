"""Sub-word learners and appliers against plain-Python versions."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from spindle.operators import lexicon as U
from spindle.operators import merges as M


def plain_bpe(words: dict[str, int], n_merges: int, min_frequency: int = 2, continuation: bool = False) -> list[tuple[str, str, int]]:
    """Counts all pairs anew for every merge."""
    seqs = {w: [c if (i == 0 or not continuation) else "##" + c for i, c in enumerate(w)] for w in words}
    out = []
    for _ in range(n_merges):
        cnt: dict = {}
        for w, s in seqs.items():
            for a, b in zip(s, s[1:]):
                cnt[(a, b)] = cnt.get((a, b), 0) + words[w]
        if not cnt:
            break
        (a, b), n = min(cnt.items(), key=lambda kv: (-kv[1], kv[0][0], kv[0][1]))
        if n < min_frequency:
            break
        out.append((a, b, n))
        m = a + (b[2:] if continuation and b.startswith("##") else b)
        for w, s in seqs.items():
            o, i = [], 0
            while i < len(s):
                if i < len(s) - 1 and s[i] == a and s[i + 1] == b:
                    o.append(m)
                    i += 2
                else:
                    o.append(s[i])
                    i += 1
            seqs[w] = o
    return out



def plain_segments(word):
    for k in range(len(word)):
        for cuts in combinations(range(1, len(word)), k):
            at = [0, *cuts, len(word)]
            yield [word[i:j] for i, j in zip(at, at[1:])]


def random_words(seed, alphabet, n, longest):
    rng = random.Random(seed)
    return {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, longest))): rng.randrange(1, 30) for _ in range(n)}


def learned(spark, words, n, **how):
    wf = spark.createDataFrame(list(words.items()), "word string, freq bigint")
    merges, final = M.learn_merges(spark, wf, n, **how)
    return [(r["left"], r["right"], r["n"]) for r in merges.orderBy("rank").collect()], merges, final


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij"])
def test_merges_equal_the_plain_learner(spark, alphabet):
    words = random_words(1, alphabet, 150, 10) | {"aaa": 4, "aaaa": 2, "ababab": 9}
    for cont in (False, True):
        got, merges, final = learned(spark, words, 25, continuation=cont, candidates=12)
        assert got == plain_bpe(words, 25, continuation=cont)
        ranks = {(r["left"], r["right"]): r["rank"] for r in merges.collect()}
        for r in final.collect():
            assert U.merge_word(r["word"], ranks, cont) == r["seq"].split(M.SEP)


def test_many_merges_in_few_rounds(spark, monkeypatch):
    rounds = []
    inner = M.next_merges
    monkeypatch.setattr(M, "next_merges", lambda *a: rounds.append(inner(*a)) or rounds[-1])
    words = random_words(2, "abcdefghijklmnopqrstuvwxyz", 1500, 12)
    got, *_ = learned(spark, words, 150)
    assert got == plain_bpe(words, 150)
    assert len(rounds) < 150 / 5


def test_next_merges_are_exact():
    """Decisions from pairs and triples alone, for many small corpora, all candidates or few."""
    for seed in range(120):
        rng = random.Random(seed)
        words = random_words(seed, "abcd"[: rng.randrange(2, 5)] + "efgh" * (seed % 2), 40, 9)
        pairs, triples = {}, {}
        for w, f in words.items():
            for i in range(len(w) - 1):
                pairs[w[i : i + 2]] = pairs.get(w[i : i + 2], 0) + f
            for i in range(len(w) - 2):
                triples[tuple(w[i : i + 3])] = triples.get(tuple(w[i : i + 3]), 0) + f
        top = sorted(((p[0], p[1], n) for p, n in pairs.items()), key=lambda x: (-x[2], x[:2]))
        few = rng.choice([3, 8, len(top)])
        batch = M.next_merges(top[:few], few < len(top), triples, 50, 2, lambda a, b: a + b, lambda s: False)
        assert batch and [(a, b, n) for a, b, _, n in batch] == plain_bpe(words, len(batch))


def test_learn_stops_below_min_frequency(spark):
    assert learned(spark, {"ab": 1, "cd": 1}, 5, min_frequency=2)[0] == []
    wf = spark.createDataFrame([], "word string, freq bigint")
    assert M.learn_merges(spark, wf, 5)[0].collect() == []


def test_vocabulary_size_counts_specials_and_characters(spark):
    wf = spark.createDataFrame(list(random_words(3, "abcde", 100, 9).items()), "word string, freq bigint")
    merges, vocab = M.learn_to_size(spark, wf, 20, specials=("[UNK]", "[PAD]"))
    rows = sorted((r["tier"], r["place"], r["token"]) for r in vocab.collect())
    assert merges.count() == 20 - 2 - 5 and len(rows) == 20
    assert [t for *_, t in rows[:2]] == ["[UNK]", "[PAD]"] and [t for *_, t in rows[2:7]] == list("abcde")


def test_lines_and_atoms(spark):
    rows = spark.createDataFrame([("a b a b\na b",), ("a b",), (None,)], "text string")
    merges, _ = M.learn_merges(spark, M.line_freq(rows), 3)
    assert [r["merged"] for r in merges.orderBy("rank").collect()][:2] == [" b", "a b"]
    from pyspark.sql import functions as F

    atoms = spark.createDataFrame([(["C", "l", "Cl"],), (["C", "l", "Cl"],), (["Cl", "O"],), (["Cl", "O"],)], "t array<string>")
    merges, words = M.learn_spe(spark, atoms, F.col("t"), 6)
    got = [(r["left"], r["right"], r["merged"], r["n"]) for r in merges.orderBy("rank").collect()]
    # C + l makes a symbol that was there before: its pairs are counted anew.
    assert got == [("C", "l", "Cl", 2), ("Cl", "Cl", "ClCl", 2)]


def plain_lexicon(words, n_types, min_count, tolerance, share):
    """The same learner with all segmentations of every word written out."""
    subs = {}
    for w, f in words.items():
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                n, by = subs.setdefault(w[i:j], [0, set()])
                subs[w[i:j]][0] += f
                by.add(w)
    lex = {m: n for m, (n, by) in subs.items() if len(m) == 1 or (n >= min_count and len(by) > 1)}
    for w, f in words.items():
        if len(w) > 1 and f >= min_count:
            lex[w] = max(lex.get(w, 0), f)
    cost_of = lambda c: {m: -math.log(n / sum(c.values())) for m, n in c.items()}
    cost, trail = cost_of(lex), []
    while True:
        before = math.inf
        while True:
            counts, total = {}, 0.0
            for w, f in words.items():
                ways = [s for s in plain_segments(w) if all(m in cost for m in s)]
                p = [math.exp(-sum(cost[m] for m in s)) for s in ways]
                total -= f * math.log(sum(p))
                for s, x in zip(ways, p):
                    for m in s:
                        counts[m] = counts.get(m, 0.0) + f * x / sum(p)
            cost = cost_of(counts)
            trail.append(total)
            if before - total <= tolerance * total:
                break
            before = total
        letters = 1 + sum(len(m) == 1 for m in cost)
        net = {}
        for m in cost:
            if len(m) > 1:
                other = min(sum(cost[x] for x in s) for s in plain_segments(m) if len(s) > 1 and all(x in cost for x in s))
                net[m] = counts[m] * (other - cost[m]) - (len(m) + 1) * math.log(letters)
        drop = min(max(sum(x < 0 for x in net.values()), len(net) - n_types), max(1, int(share * len(net))))
        if drop <= 0 or not net:
            return counts, cost
        for m in sorted(net, key=lambda m: (round(net[m], 9), m))[:drop]:
            del cost[m]


def test_lexicon_equals_plain_learner(spark):
    words = random_words(5, "abc", 120, 6)
    wf = spark.createDataFrame(list(words.items()), "word string, freq bigint")
    counts, cost = plain_lexicon(words, 15, 3, 1e-2, 0.75)
    got = {r["morph"]: (r["count"], r["cost"]) for r in U.learn_unigram_lexicon(spark, wf, 15, 3, 1e-2).collect()}
    assert set(got) == set(cost) and sum(len(m) > 1 for m in got) <= 15
    for m, (n, c) in got.items():
        assert n == pytest.approx(counts[m], rel=1e-6) and c == pytest.approx(cost[m], rel=1e-6)


def test_corpus_cost_falls(spark):
    wf = spark.createDataFrame(list(random_words(6, "abcd", 100, 8).items()), "word string, freq bigint")
    lexicon = U._with_cost(U.frequent_substrings(wf).unionByName(spark.createDataFrame([(c, 50) for c in "abcd"], "morph string, n bigint")), "n")
    from pyspark.sql import functions as F

    graph = U.edges(wf, lexicon.select(F.col("morph").alias("key"))).withColumnRenamed("key", "morph").join(wf, "word")
    costs = [U.converge(graph, lexicon, t)[1] for t in (1.0, 0.01)]
    assert costs[1] <= costs[0]


def test_frequent_substrings_of_any_length(spark):
    words = random_words(7, "ab", 60, 14) | {"x" * 40 + "y": 2, "z" + "x" * 40: 1}
    wf = spark.createDataFrame(list(words.items()), "word string, freq bigint")
    want = {}
    for w, f in words.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                n, by = want.setdefault(w[i:j], (0, set()))
                want[w[i:j]] = (n + f, by | {w})
    got = {r["morph"]: r["n"] for r in U.frequent_substrings(wf, 3).collect()}
    assert got == {m: n for m, (n, by) in want.items() if n >= 3 and len(by) > 1}
    assert "x" * 40 in got


def test_appliers(spark):
    words = sorted(random_words(8, "abcd", 80, 9)) + ["xyz", "abxcd"]
    tok = spark.createDataFrame([(i, w) for i, w in enumerate(words + words[:5])], "id long, token string")
    merges = [("a", "b", "ab"), ("c", "d", "cd"), ("ab", "cd", "abcd"), ("b", "a", "ba")]
    df = spark.createDataFrame([(i, *m, 1) for i, m in enumerate(merges)], "rank int, left string, right string, merged string, n bigint")
    got = U.apply_merges(tok, df).collect()
    assert len(got) == len(words) + 5

    def plain(w):
        s = list(w)
        while True:
            found = [(merges.index((*p, "".join(p))), i) for i, p in enumerate(zip(s, s[1:])) if (*p, "".join(p)) in merges]
            if not found:
                return s
            _, i = min(found)
            s[i : i + 2] = ["".join(s[i : i + 2])]

    assert all(r["pieces"] == plain(r["token"]) for r in got)
    vocab = ["a", "ab", "abc", "b", "c", "d", "##a", "##b", "##c", "##d", "##cd", "##dab"]
    got = {r["token"]: r["pieces"] for r in U.apply_wordpiece(tok, spark.createDataFrame([(v,) for v in vocab], "token string")).collect()}

    def greedy(w):
        out, at = [], 0
        while at < len(w):
            ends = [e for e in range(len(w), at, -1) if ("##" if at else "") + w[at:e] in vocab]
            if not ends:
                return ["[UNK]"]
            out.append(("##" if at else "") + w[at : ends[0]])
            at = ends[0]
        return out

    assert got == {w: greedy(w) for w in words}
    cost = {"a": 2.0, "b": 2.5, "c": 2.25, "d": 3.0, "ab": 2.0, "bcd": 3.5, "cd": 3.0}
    lex = spark.createDataFrame(list(cost.items()), "morph string, cost double")
    price = lambda s: sum(cost.get(m, 13.0 if len(m) == 1 else math.inf) for m in s)
    for r in U.apply_viterbi(tok, lex).collect():
        assert "".join(r["pieces"]) == r["token"]
        assert price(r["pieces"]) == pytest.approx(min(map(price, plain_segments(r["token"]))))


def test_a_batch_of_merges_is_plain_replacement(spark):
    from pyspark.sql import functions as F

    lines = ["aaaa", "abab", "xaab", "a$b\\Ea", "b", "ab", ".a.b.", "ba"]
    batch = [("a", "b", "ab", 9), ("ab", "ab", "abab", 5), (".", "a", ".a", 3), ("a", "a", "aa", 2), ("$", "b", "$b", 1), ("\\", "E", "\\E", 1)]
    rows = spark.createDataFrame([(M.SEP.join(x),) for x in lines], "seq string")
    after = M._merged_seq(F.col("seq"), batch)
    assert "regexp" not in str(after._jc).lower()
    for r in rows.select("seq", after.alias("after")).collect():
        want = r["seq"].split(M.SEP)
        for left, right, merged, _ in batch:
            i = 0
            while i < len(want) - 1:
                if want[i : i + 2] == [left, right]:
                    want[i : i + 2] = [merged]
                i += 1
        assert r["after"].split(M.SEP) == want


def test_learner_and_viterbi_make_no_edge_table(spark, monkeypatch):
    """Blocks of few words, long words among them; edges are made where the words lie."""
    monkeypatch.setattr(U, "edges", lambda *a: pytest.fail("edges are joined"))
    monkeypatch.setattr(U, "BLOCK_CHARS", 50)
    monkeypatch.setattr(U, "ALIKE", 4)
    words = random_words(5, "abc", 120, 6)
    counts, cost = plain_lexicon(words, 15, 3, 1e-2, 0.75)
    lexicon = U.learn_unigram_lexicon(spark, spark.createDataFrame(list(words.items()), "word string, freq bigint"), 15, 3, 1e-2)
    got = {r["morph"]: (r["count"], r["cost"]) for r in lexicon.collect()}
    assert set(got) == set(cost)
    for m, (n, c) in got.items():
        assert n == pytest.approx(counts[m], rel=1e-6) and c == pytest.approx(cost[m], rel=1e-6)
    tok = spark.createDataFrame([(w,) for w in [*words, "axb", "🙂a", "", None]], "token string")
    cuts = []
    for most in (U.WHOLE_LEXICON, 0):
        monkeypatch.setattr(U, "WHOLE_LEXICON", most)
        cuts.append({r["token"]: r["pieces"] for r in U.apply_viterbi(tok, lexicon).collect()})
    assert cuts[0] == cuts[1] and set(cuts[0]) == {*words, "axb", "🙂a"}
    assert all("".join(pieces) == w for w, pieces in cuts[0].items())


def test_runs_are_counted_where_the_words_lie(spark):
    from collections import Counter

    rows = [("a\x01b\x01a\x01b\x01c", 3), ("a", 9), ("c\x01\x01c", 2), ("##ü\x01b", 4), ("a\x01a\x01a\x01a", 5), ("b\x01c", 1)]
    words = spark.createDataFrame([(s, f, s) for s, f in rows], "word string, freq bigint, seq string")

    def runs(k):
        out = Counter()
        for s, f in rows:
            x = s.split("\x01")
            for i in range(len(x) - k + 1):
                out[tuple(x[i : i + k])] += f
        return out

    pairs = M.pair_counts(words, "seq")
    assert {(r["left"], r["right"]): r["n"] for r in pairs.collect()} == runs(2)
    assert "Generate" not in pairs._jdf.queryExecution().executedPlan().toString()
    top = [("a", "b", 0), ("b", "a", 0), ("b", "c", 0), ("a", "a", 0), ("x", "a", 0)]
    known = {(a, b) for a, b, _ in top}
    assert M._triples(spark, words, top) == {t: n for t, n in runs(3).items() if t[:2] in known and t[1:] in known}
    gone = words.withColumn("before", F.lit("a\x01b"))
    delta = {(r["s0"], r["s1"]): r["n"] for r in M._run_counts(gone, {"seq": 1, "before": -1}, 2).where("n <> 0").collect()}
    want = runs(2)
    want["a", "b"] -= sum(f for _, f in rows)
    assert delta == {p: n for p, n in want.items() if n}
