import hashlib
import re

import pytest
from helpers import edge_docs, edge_rows, no_docs, rows
from pyspark.sql import functions as F

from spindle.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for no, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


CARD = "4539 1488 0343 6467"
TEXTS = [
    f"Ünï a.b@c.d-e.f, x@y and {CARD}; call +49 (30) 123-45678.", "1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.1 0000000255.1.1.1 1.1.1", "a@b.c-d%x@y.z a@@b.c a@b..c @x.y",
    "+1 (555) 010-9999 4539148803436467 end", "+1234567890123456 +12 +1((( 4 +1-2", "12345678901234567890 0000-0000-0000 1-2-3 4", "\x01a@b.c\x02 +1 23 456 789\x01", "",
    "mail@example.org" * 5, "日本 a@b.co 日本 10.0.0.1 🙂 +4930123456", "9" * 5000, "a" * 5000 + "@b.c", "." * 300 + "1" * 300, "1.1.1.1." * 200, "a-" * 3000,
]


def listing(spans):
    return ",".join(f"{k}:{a}:{z}" for a, _, z, k in spans)


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return df, {r["doc_id"]: r for r in rows(pii.find_personal_data(df).withColumn("all", pii.listed(F.col("spans"))).withColumn("own", pii.listed(F.filter("spans", lambda s: s["base"]))))}


def test_base_spans(found):
    for i, t in enumerate(TEXTS):
        assert found[1][i]["own"] == listing(base(t)), t


def test_redaction(spark, found):
    df, spans = found
    got = {r["doc_id"]: r["text"] for r in rows(pii.redact(df))}
    for i, t in enumerate(TEXTS):
        out, at = [], 0
        for s in spans[i]["spans"] or []:
            if s["start"] >= at:
                out += [t[at : s["start"]], f"[{pii.KINDS[s['kind_no']].upper()}]"]
            at = max(at, s["stop"])
        assert got[i] == "".join(out) + t[at:]
    assert "[EMAIL]" in got[0] and CARD not in got[0]


def test_added_spans(spark):
    """With enough to learn from, what the base's greedy matches swallow is found, and numbers are left alone."""
    import random

    rng = random.Random(3)

    def card():
        d = [rng.randrange(10) for _ in range(15)]
        return next(s for s in ("".join(map(str, d)) + str(c) for c in range(10)) if luhn(s))

    data = [(i, f"words {card()} and {rng.randrange(99999)} then +1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}.") for i in range(300)]
    swallowed = card()
    data += [(1000, f"see +1 (555) 555-2678 {swallowed} there"), (1001, "in 2024 there were 12345 of 99 things"), (1002, 'token = "a1b2c3d4e5f6a7b8c9d0"')]
    data += [(2000 + i, f'token = "{rng.randrange(16**20):020x}" x') for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["all"] for r in rows(pii.find_personal_data(df).withColumn("all", pii.listed(F.col("spans"))))}
    assert "phone:4:21" in got[1000] and f"card:22:{22 + len(swallowed)}" in got[1000]
    assert got[1001] == "" and got[1002].startswith("secret:")


def test_rare_kinds_are_found_at_any_size(spark):
    """A kind with a few candidates among more numbers than the trees learn from is redacted."""
    numbers = spark.range(pii.TRAIN_ROWS + 10_000).select(F.col("id").alias("doc_id"), F.format_string("lot %d of it", 10_000 + F.col("id")).alias("text"))
    cards = [(100_000 + i, f"paid with {CARD} on day {i}") for i in range(30)]
    rare = [(200_000 + i, f"ssn {i + 100}-12-{i + 1000} given") for i in range(3)] + [(300_000, "token = a1b2c3d4e5f6a7b8c9d0"), (300_001, "write to jane [at] mail [dot] org")]
    got = pii.find_personal_data(numbers.unionByName(spark.createDataFrame(cards + rare, "doc_id long, text string"))).where("spans IS NOT NULL")
    got = {r["doc_id"]: r["all"] for r in rows(got.withColumn("all", pii.listed(F.col("spans"))))}
    assert all(got.get(200_000 + i) == "id:4:15" for i in range(3))
    assert got.get(300_000) == "secret:0:28" and got.get(300_001) == "email:9:33"
    assert not any(i < 100_000 for i in got)


def test_long_secrets_go_whole(spark):
    secrets = ["a1B2" * 50, "x9" * 44, "aB3/" * 30 + "Q==", "h1" * 20 + "." + "p2" * 300 + "." + "s3_-" * 20, "k7" * 100_000]
    data = [(i, f"token = {s}. Then words") for i, s in enumerate(secrets)] + [(100 + i, f"line {i} of 12345") for i in range(50)]
    data += [(200, "key AKIA" + "Z9" * 20 + " end"), (201, "token = " + "a1.b2c3d4e5" * 30_000)]
    got = {r["doc_id"]: r["text"] for r in rows(pii.redact(spark.createDataFrame(data, "doc_id long, text string")))}
    assert [got[i] for i in range(len(secrets))] == ["[SECRET]. Then words"] * len(secrets)
    assert got[200] == "key [SECRET] end" and got[100] == "line 0 of 12345"


def test_spans_behind_dropped_ones_stay(spark, monkeypatch):
    """A span that overlaps only a dropped span is kept."""
    spans = {
        "a": [(0, 10, "card"), (5, 20, "phone"), (15, 30, "id")],
        "b": [(0, 10, "card"), (10, 12, "id"), (11, 20, "id"), (11, 14, "ip"), (20, 21, "ip")],
        "c": [(3 * i, 3 * i + 4, "id") for i in range(2000)],
    }

    def greedy(of):
        out, at = [], 0
        for start, stop, kind in sorted(of, key=lambda s: (s[0], -s[1], pii.KINDS.index(s[2]))):
            if start >= at:
                out.append((start, stop, kind))
                at = stop
        return out

    data = [(k, kind, start, stop, False, True, True) for k, of in spans.items() for start, stop, kind in of]
    df = spark.createDataFrame(data, "_k string, kind string, start long, stop long, base boolean, valid boolean, chosen boolean")
    monkeypatch.setattr(pii, "candidates", lambda found: df)
    monkeypatch.setattr(pii, "scored", lambda spans: df)
    got = pii.chosen_spans(df).collect()
    for k, of in spans.items():
        assert sorted((r["start"], r["stop"], r["kind"]) for r in got if r["_k"] == k) == sorted(greedy(of))


def test_thresholds_need_evidence():
    def threshold(*counts):
        return pii._thresholds([{"kind": "id", "bucket": b, "good": g, "n": n} for b, g, n in counts]).get("id")

    assert threshold((19, 1.0, 1)) is None and threshold((19, 10.0, 10), (18, 10.0, 10)) == 0.9
    assert threshold((19, 50.0, 50), (3, 0.0, 50)) == 0.95


def test_training_shares():
    assert pii._shares({"a": 1, "b": 100, "c": 1000}, 61) == {"a": 1, "b": 30, "c": 30}
    assert pii._shares({"a": 1, "b": 2}, 61) == {"a": 1, "b": 2}


def test_edge_rows(spark):
    df = pii.find_personal_data(edge_docs(spark)).withColumn("own", pii.listed(F.filter("spans", lambda s: s["base"])))
    got = sorted((str(r["doc_id"]), r["own"]) for r in rows(df))
    assert got == sorted((str(r[0]), listing(base(r[1]))) for r in edge_rows())
    assert pii.find_personal_data(no_docs(spark)).collect() == []
    clean = pii.redact(edge_docs(spark))
    assert clean.columns == edge_docs(spark).columns and sorted(map(str, clean.collect())) == sorted(map(str, edge_docs(spark).collect()))
    assert hashlib.sha256(b"").hexdigest()  # the digest of no spans
