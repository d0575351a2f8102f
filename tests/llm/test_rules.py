import re
from collections import Counter

from helpers import edge_docs, edge_rows, no_docs, rows

from spindle.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_measures(spark):
    texts = [
        "a b c a b c", "a b c d", "a a a a a", "a b", "", None, "x\nx\n\n \nx y\nx", "é#*$ %&|<>\u0085b\x1cc a\x0bb",
        "one two three four one two three five one two three", "a b a b a b a b c d e f", "\n".join(["same line here"] * 40), " \t\x0c ", "\n",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(rules.measured(df))}
    for i, t in enumerate(texts):
        want = measures(t)
        assert {k: got[i][k] for k in want} == want, t


def test_edge_rows(spark):
    got = rows(rules.quality_rules(edge_docs(spark)))
    want = sorted((str(r[0]), *measures(r[1]).values()) for r in edge_rows())
    assert sorted((str(r["doc_id"]), *(r[k] for k in measures(""))) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert {r["host"] for r in got} == {"s1", "s2", "s3", None}
    assert rules.quality_rules(no_docs(spark)).collect() == []


def test_hosts(spark):
    """A host that fails a rule as a rule loses the documents that fail it; one such document elsewhere stays."""
    clean = " ".join(f"w{i}" for i in range(60))
    dirty = " ".join(f"w{i}###" for i in range(60))
    data = [(i, dirty if i % 10 else clean, "spam") for i in range(200)]
    data += [(1000 + i, clean, f"h{i % 9}") for i in range(400)]
    data += [(5000, dirty, "h1"), (5001, dirty, "tiny"), (5002, dirty, None), (5003, clean, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in rows(rules.quality_rules(df))}
    assert all(got[i]["kept"] == (i % 10 == 0) for i in range(200))
    assert got[1]["host_failed"] == "symbols" and got[1]["host"] == "spam"
    assert all(got[1000 + i]["kept"] for i in range(400)) and got[5000]["kept"] and got[5003]["kept"]
    assert got[5001]["kept"] and got[5002]["kept"]


def test_a_long_tail_of_tiny_hosts_is_not_condemned(spark):
    """Rates of hosts with one or two documents spread by chance; that is no sign of bad hosts."""
    clean = " ".join(f"w{i}" for i in range(60))
    dirty = " ".join(f"w{i}###" for i in range(60))
    one = [(i, dirty if i % 20 == 0 else clean, f"h{i}") for i in range(400)]
    got = rows(rules.quality_rules(spark.createDataFrame(one, "doc_id long, text string, source string")))
    assert len(got) == 400 and all(r["kept"] for r in got)
    two = one + [(1000 + i, clean, f"h{i}") for i in range(400)]
    two += [(5000 + i, dirty if i % 10 else clean, "spam") for i in range(300)]
    got = {r["doc_id"]: r for r in rows(rules.quality_rules(spark.createDataFrame(two, "doc_id long, text string, source string")))}
    assert all(got[i]["kept"] for i in range(400)) and all(got[5000 + i]["kept"] == (i % 10 == 0) for i in range(300))


def test_prior_of_known_hosts(spark):
    """The fit finds the mean and strength of a beta-binomial."""
    import random

    rnd = random.Random(5)
    flags = []
    for h in range(600):
        rate = rnd.betavariate(2.0, 18.0)
        flags += [(f"h{h}", rnd.random() < rate) for _ in range(rnd.choice((1, 40, 100)))]
    df = spark.createDataFrame(flags, "host string, f boolean").select("host", *[rules.F.col("f").alias(f"fails_{r}") for r in rules.RULES])
    per = rules.host_verdicts(df).select("n_docs", "short_rate").collect()
    # A host of one document that fails nothing has the rate m s / (1 + s); one that fails has (1 + m s) / (1 + s).
    low, high = min(r[1] for r in per if r[0] == 1), max(r[1] for r in per if r[0] == 1)
    strength = 1 / (high - low) - 1
    assert 13 < strength < 30 and 0.08 < low * (1 + strength) / strength < 0.12
