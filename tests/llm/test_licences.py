import random
import re

from helpers import edge_docs, edge_rows, no_docs, rows

from spindle.llm import licences as L

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w = WORDS.findall((text or "").translate(LOWER))
    places = sorted((i, label) for phrase, label in L.PHRASES for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p)
    return {
        "n_words": len(w), "n_base": len(places), "first_word": places[0][0] if places else None,
        "last_word": places[-1][0] if places else None, "base_labels": ",".join(sorted({x for _, x in places})),
    }


def scan(spark, data):
    return rows(L.licence_scan(spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS p", "3 AS at")))


def test_base_places(spark):
    texts = [
        "Released UNDER the MIT-License. under the\nmit license!", "Apache License, Version 2.0", "cc by nc cc-by-nc-4.0 CC BY NC", "under the mit", "",
        None, "Kelvin licenKe", "cc by", "xunder the mit license", "under  the éMIT License", "nc cc by nc " * 50,
    ]
    got = {r["doc_id"]: r for r in scan(spark, list(enumerate(texts)))}
    for i, t in enumerate(texts):
        want = base(t)
        assert {k: got[i][k] for k in want} == want, t
        assert set(filter(None, want["base_labels"].split(","))) <= set(got[i]["labels"].split(","))
        assert 0 <= got[i]["score"] <= 1
    assert got[0]["score"] == 1 and got[3]["score"] == 0 and got[3]["labels"] == ""


def test_long_templates_survive_edits(spark):
    words = L.TEMPLATES[0][0].split()
    edited = words[:9] + ["really"] + words[9:15] + words[16:]
    far = " filler ".join(words)
    half = " ".join(words[: len(words) // 3])
    got = {r["doc_id"]: r for r in scan(spark, [(1, "x " * 30 + " ".join(edited) + " y"), (2, far), (3, half), (4, " ".join(words).upper())])}
    assert got[1]["labels"] == "mit" and 0.6 <= got[1]["score"] < 1 and got[1]["n_base"] == 0
    assert got[2]["labels"] == got[3]["labels"] == ""
    assert got[4]["labels"] == "mit" and got[4]["score"] == 1


def test_edge_rows(spark):
    got = rows(L.licence_scan(edge_docs(spark)))
    want = [base(r[1]) | {"doc_id": r[0]} for r in edge_rows()]
    key = lambda r: (str(r["doc_id"]), r["n_words"])
    assert [{k: g[k] for k in w} for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True)] == sorted(want, key=key)
    assert L.licence_scan(no_docs(spark)).collect() == []


def test_rows_that_share_an_id_stay_apart(spark):
    got = scan(spark, [(1, "cc by nc"), (1, "plain"), (1, "cc by nc")])
    assert sorted(r["n_base"] for r in got) == [0, 1, 1]


def labels_by_force(text):
    """Labels and score by trying every window of every merged band of diagonals, runs by quadratic search."""
    w = WORDS.findall((text or "").translate(LOWER))
    labels, score = set(), 0.0
    for _, template, label, _, n in L._catalogue():
        grams = L._grams(template)
        votes = sorted((p - t, p, t) for p in range(len(w) - L.K + 1) for t, g in enumerate(grams) if g == " ".join(w[p : p + L.K]))
        drift, share = (0, 1) if n <= L.SHORT else (L.DRIFT, L.COVERAGE)
        bands = []
        for v in votes:
            if not bands or v[0] - bands[-1][-1][0] > drift:
                bands.append([])
            bands[-1].append(v)
        for band in bands:
            for start in {p for _, p, _ in band}:
                inside = sorted((p, t) for _, p, t in band if start <= p <= start + int(n * L.STRETCH) + L.DRIFT - L.K)
                runs = []
                for i, (p, t) in enumerate(inside):
                    runs.append(1 + max((runs[j] for j in range(i) if inside[j][0] < p and inside[j][1] < t), default=0))
                if max(runs) >= len(grams) * share:
                    labels.add(label)
                    score = max(score, max(runs) / len(grams))
    return ",".join(sorted(labels)), score


def test_repeated_words_do_not_hide_a_find(spark):
    mit = L.TEMPLATES[0][0]
    tail = " ".join(mit.split()[-3:])
    texts = [mit + f" {tail}" * 20, f"{tail} " * 20 + mit, f"{mit} " * 3, f"{tail} " * 40, " ".join(reversed(mit.split()))]
    got = {r["doc_id"]: r for r in scan(spark, list(enumerate(texts)))}
    assert [got[i]["labels"] for i in range(5)] == ["mit", "mit", "mit", "", ""]
    assert [got[i]["score"] for i in range(3)] == [1.0, 1.0, 1.0]


def test_labels_equal_brute_force(spark):
    rnd = random.Random(11)
    texts = ["all rights reserved all rights reserved", "under the mit license all rights reserved"]
    for _ in range(60):
        words = []
        for _ in range(rnd.randint(1, 4)):
            part = rnd.choice(L.TEMPLATES)[0].split()
            if rnd.random() < 0.5:  # clauses in another order
                cut = rnd.randrange(len(part))
                part = part[cut:] + part[:cut]
            kind = rnd.random()
            if kind < 0.3:
                part = [x for x in part if rnd.random() > 0.08]
            elif kind < 0.6:
                part = [y for x in part for y in ([x, "put in"] if rnd.random() < 0.1 else [x])]
            elif kind < 0.8:
                part += part[-rnd.randint(3, 8) :] * rnd.randint(1, 9)
            words += part
        texts.append(" ".join(words))
    got = {r["doc_id"]: r for r in scan(spark, list(enumerate(texts)))}
    for i, t in enumerate(texts):
        labels, score = labels_by_force(t)
        assert got[i]["labels"] == labels and abs(got[i]["score"] - score) < 1e-12, t
