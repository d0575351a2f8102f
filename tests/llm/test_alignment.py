import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

from helpers import edge_docs, edge_rows, no_docs

from spindle.llm import alignment as G
from spindle.llm.bpe import byte_alphabet

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(data):
    """All of it with the libraries and loops over tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(A_PATH)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    alphabet = byte_alphabet()

    def b_bytes(i):
        piece = b_lib.id_to_piece(i)
        m = re.fullmatch("<0x(..)>", piece)
        return bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()

    def spans(ids, raw):
        at = 0
        for i in ids:
            yield i, at, at + len(raw(i))
            at += len(raw(i))

    rows = []
    for doc, text in data:
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        a_bytes = lambda i: bytes(alphabet[c] for c in a_lib.id_to_token(i))
        want = (" " + (text or "")).encode()
        if b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
            rows.append((doc, [], [], [], ""))
            continue
        sa, sb = list(spans(a, a_bytes)), list(spans(b, b_bytes))
        links = [(x, y) for x, s, e in sa for y, t, f in sb if max(s, t) < min(e, f)]
        both = sorted({e for *_, e in sa} & {f for *_, f in sb})
        group = lambda at, lo, hi: ",".join(str(i) for i, s, e in at if lo <= s and e <= hi)
        text = ";".join(f"{group(sa, lo, hi)}|{group(sb, lo, hi)}" for lo, hi in zip([0, *both], both))
        rows.append((doc, a, b, links, (len(both), hashlib.sha256(text.encode()).hexdigest())))
    count = Counter(x for r in rows for x in r[3])
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for doc, a, b, links, groups in rows:
        n, sha = groups or (0, "")
        out.append((doc, len(a), len(b), n, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in G.align(df, A_PATH, B_PATH).select(*COLUMNS).collect()), key=str)




SAMPLES = [
    "The quick brown fox, the lazy dog.", "Ça coûte 12,50 € à Zürich", "  two leading blanks", "tab\tand\nlines\n\n", "日本語のテキスト🙂", "naïve façade naïve",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "x" * 300, "▁under", "é combining", "the the the the", "the the the the", "a", " ", " nbsp", "don't can't we'll",
]


def test_matches_plain_version(spark):
    data = [(i, t) for i, t in enumerate(SAMPLES)] + [(None, "the fox"), (3, None), (3, "")]
    assert result(spark.createDataFrame(data, "doc_id long, text string").repartition(3)) == plain(data)


def test_many_chunks(spark, monkeypatch):
    """Chunks of a few documents give the same corpus-wide counts as one chunk."""
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 400").collect()][:60]
    df = spark.createDataFrame(data * 2, "doc_id long, text string").repartition(4)
    assert result(df) == plain(data * 2)


def test_edge_rows(spark):
    short = lambda df: df.where("text IS NULL OR length(text) < 1000")
    data = [(r[0], r[1]) for r in edge_rows() if r[1] is None or len(r[1]) < 1000]
    assert result(short(edge_docs(spark))) == plain(data)
    assert len(result(edge_docs(spark))) == len(edge_rows())
    assert G.align(no_docs(spark), A_PATH, B_PATH).collect() == []


def test_bitmaps():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 400, 3000):
        x, y = (np.sort(rng.choice(4000, n, replace=False)) for _ in range(2))
        a, b = G.container(x, 4000), G.container(y, 4000)
        assert (G.members(a) == x).all() and G.popcount(a) == n
        assert (G.members(G.merged(a, b, 4000)) == np.union1d(x, y)).all()
        assert len(a) <= 1 + 4000 // 8
    docs, times = np.array([2, 7, 9]), np.array([1, 6, 3])
    posting = G.planes(docs, times, 10)
    assert [G.members(p).tolist() for p in posting] == [[2, 9], [7, 9], [7]]
    assert G.counts(posting, 10) == (3, 10)


def test_long_blanks(spark):
    """A run of blanks on which the fast encoder gives up."""
    text = "x" + " " * 1_200_000 + "y"
    (row,) = result(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert row[1] > 0 and row[4] == row[1] + row[2] - row[3]
