"""The pipeline against a plain version of its stages on a small corpus."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, edge_docs, no_docs, rows
from test_neardup import brute as near_duplicates
from test_pii import base as personal_data
from test_rules import measures
from tokenizers import Tokenizer

from spindle.llm import crf, pii, rules

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 7)))
    out = []
    for i in range(160):
        lines = [" ".join(word() for _ in range(rng.randrange(8, 20))).capitalize() + "." for _ in range(rng.randrange(4, 9))]
        good = i % 5 != 0
        if not good:
            lines = [x.upper().replace(" ", "!! ") if i % 2 else x.replace(" ", "### ") for x in lines]
        if i % 11 == 1:
            lines[0] += f" mail me.{i}@host{i}.example.org or +1 (555) 010-{1000 + i}"
        out.append((i, "\n".join(lines), good))
    good_texts = [t for _, t, g in out if g]
    extra = [(200 + i, t, True) for i, t in enumerate(good_texts[:12])]  # exact copies
    extra += [(300 + i, t.replace(".", "!", 1), True) for i, t in enumerate(good_texts[20:30])]  # near copies
    extra += [(400, "short text", True), (401, "", True), (402, None, True), (403, " ".join(["again and again"] * 40), True)]
    return out + extra


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    data = corpus()
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t, _ in data], DOCS)
    docs.repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(g), 0) for i, _, g in data if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def plain(spark, folder):
    """Texts that reach the packer, by id."""
    table = spark.read.parquet(f"{folder}/documents.parquet")
    theta = np.array(crf.train(table, spark.read.parquet(f"{folder}/labels.parquet")))
    docs = {}
    for i, t, _ in corpus():
        x, chars, n = crf.line_features([(t or "").encode()])
        p, _, _ = crf.marginals(x @ theta[:-6], n, theta[-6:-2].reshape(2, 2))
        share = ((chars + 1) * p).sum() / (chars + 1).sum()
        if 1 / (1 + np.exp(-(theta[-2] * (share - 0.5) + theta[-1]))) >= crf.GOOD:
            docs[i] = t
    m = {i: measures(t) for i, t in docs.items()}
    fails = {i: {r for r, (cond, _) in rules.RULES.items() if eval(cond, {}, v)} for i, v in m.items()}  # noqa: S307
    hosts = defaultdict(list)
    for i in docs:
        hosts[f"s{i % 3}"].append(i)
    bad = set()
    for r, (_, limit) in rules.RULES.items():
        rate = {h: np.mean([r in fails[i] for i in ids]) for h, ids in hosts.items()}
        mean, spread = np.mean([r in f for f in fails.values()]), np.var(list(rate.values()))
        s = min(max(mean * (1 - mean) / spread - 1 if spread > 1e-12 else rules.STRENGTH[1], rules.STRENGTH[0]), rules.STRENGTH[1])
        bad |= {(h, r) for h, ids in hosts.items() if (rate[h] * len(ids) + mean * s) / (len(ids) + s) > limit}
    docs = {i: t for i, t in docs.items() if not fails[i] & set(rules.BASE) and not any((f"s{i % 3}", r) in bad for r in fails[i])}
    docs = {i: docs[i] for i, _, _, kept in near_duplicates(list(docs.items())) if kept}
    for i, t in docs.items():
        out, at = "", 0
        for start, _, stop, kind in personal_data(t):
            if start >= at:
                out += t[at:start] + f"[{kind.upper()}]"
            at = max(at, stop)
        docs[i] = out + t[at:]
    return docs


def test_run(spark, folder):
    want = plain(spark, folder)
    ids = {i: [*LIBRARY.encode(t, add_special_tokens=False).ids, 0] for i, t in want.items()}
    got = rows(corpus_pipeline.run(spark, folder))
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    assert total == {i: len(x) for i, x in ids.items()}
    kept = set(total)
    assert not kept & ({i for i, _, g in corpus() if not g} | {400, 401, 402, 403})
    assert not kept & set(range(200, 212))  # one of each group of copies
    clean = {i for i, t, g in corpus() if g and i < 160 and len(t.split()) >= 50}
    assert clean <= kept


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60).selectExpr("*", "1 AS _k", "'x' AS score", "2 AS n_words", "3 AS kept")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes
    redacted = {r["text"] for r in rows(corpus_pipeline.personal_data(spark, docs, folder))}
    assert not any(re.search(r"@host[0-9]+\.", t or "") for t in redacted)
    assert pii.KINDS[0] == "email" and any("[EMAIL]" in (t or "") for t in redacted)


def test_edge_rows(spark, folder):
    for docs in (edge_docs(spark), no_docs(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    one = rows(corpus_pipeline.near_duplicates(spark, edge_docs(spark), folder))
    assert sorted(r["doc_id"] for r in one if r["doc_id"] is not None) == list(range(1, 9))


def test_repeated_ids_with_other_texts(spark, folder):
    """Of two texts with one id, the copy of another document goes and the unique one stays."""
    copied = [(i, " ".join(f"copy{i}w{j}" for j in range(60))) for i in range(12)]
    unique = [(100 + i, " ".join(f"own{i}v{j}" for j in range(60))) for i in range(12)]
    data = copied + unique + [(100 + i, t) for i, t in copied] + unique[:3]
    got = rows(corpus_pipeline.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string"), folder))
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(copied + unique)
