"""Registered queries: sources and sinks.

Sink queries write to a fresh folder under the shared checkpoint directory
and return what a reader gets back, so the round trip is checked against
the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vocab as V
from ..sources import fixtures as X
from ..sources import io as IO
from . import sql as S
from .q_sample import _STRAT, _strat
from .q_tokens import _WC, VOCAB500, _vocab500
from .registry import query


@query(
    "scan_lines",
    """SELECT doc_id AS id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, length(rtrim(unnest(l))) AS len, md5(rtrim(unnest(l))) AS sig
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
)
def q_scan_lines(spark, sf):
    lines = IO.split_lines(X.corpus(spark, sf))
    return lines.select("id", "line_no", F.length("line").alias("len"), F.md5("line").alias("sig"))


@query("scan_split_tables", S.with_(S.LABELLED, _STRAT) + "SELECT id, toxic, split FROM ss")
def q_scan_split_tables(spark, sf):
    base = IO.scratch_path(spark, "splits")
    s = _strat(spark, sf)
    for part in ("train", "valid", "test"):
        s.where(F.col("split") == part).select("id", "toxic").write.mode("overwrite").option("header", True).csv(f"{base}/labelled_{part}.csv")
    IO.register_split_dataset("labelled", base + "/labelled_{split}.csv")
    return IO.read_split_tables(spark, "labelled", schema="id bigint, toxic int")


@query("scan_headed_csv", S.with_(S.LABELLED) + "SELECT id, lang, toxic FROM labelled")
def q_scan_headed_csv(spark, sf):
    path = IO.scratch_path(spark, "csv")
    X.labelled(spark, sf).select("id", "lang", "toxic").write.option("header", True).csv(path)
    return IO.read_headed_csv(spark, path, "id bigint, lang string, toxic int")


@query(
    "scan_fragment_lists",
    "SELECT doc_id AS id, len(string_split(text, ',')) AS n_fragments, md5(array_to_string(string_split(text, ','), '|')) AS sig FROM documents",
)
def q_scan_fragment_lists(spark, sf):
    f = IO.fragment_lists(X.corpus(spark, sf))
    return f.select("id", F.size("fragments").cast("bigint").alias("n_fragments"), F.md5(F.array_join("fragments", "|")).alias("sig"))


_BENCH_VOCAB = f"""bv AS (SELECT item_id, token, CAST(max(pos) AS INTEGER) AS id FROM (
  SELECT item_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
  FROM (SELECT item_id, regexp_extract_all(lower(text), '{S.WORD_RE}', 1) AS t FROM benchmark)) GROUP BY item_id, token)"""


def _bench_vocab(spark, sf):
    b = X.table(spark, sf, "benchmark").select("item_id", F.posexplode(X.T.word_tokens("text")).alias("line_no", "token"))
    return V.scan_vocab(b, ("item_id",))


@query("scan_vocab", S.with_(_BENCH_VOCAB) + "SELECT item_id, token, id FROM bv")
def q_scan_vocab(spark, sf):
    return _bench_vocab(spark, sf)


@query(
    "sink_vocab_gaps",
    S.with_(_BENCH_VOCAB)
    + """SELECT v.item_id, v.token, v.id FROM bv v WHERE v.id <> (SELECT min(id) FROM bv w WHERE w.item_id = v.item_id)
  AND NOT EXISTS (SELECT 1 FROM bv u WHERE u.item_id = v.item_id AND u.id = v.id - 1)""",
)
def q_sink_vocab_gaps(spark, sf):
    return V.vocab_gaps(_bench_vocab(spark, sf), ("item_id",))


@query(
    "flatten_json_pages",
    """SELECT 'EV' || event_id AS chembl_id, event_type AS name,
  CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'N/A' END AS max_phase,
  CASE WHEN event_type = 'click' THEN props ELSE 'N/A' END AS formula,
  CASE WHEN event_type = 'click' THEN CAST(json_extract(props, '$.k') AS VARCHAR) ELSE 'N/A' END AS weight,
  'N/A' AS smiles FROM events""",
)
def q_flatten_json_pages(spark, sf):
    e = X.table(spark, sf, "events")
    props = F.when(
        F.col("event_type") == "click",
        F.struct(F.col("props").alias("full_molformula"), F.get_json_object("props", "$.k").alias("full_mw")),
    )
    rec = F.struct(
        F.concat(F.lit("EV"), F.col("event_id").cast("string")).alias("molecule_chembl_id"),
        F.col("event_type").alias("molecule_name"),
        F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("max_phase"),
        props.alias("molecule_properties"),
    )
    pages = e.select(F.to_json(F.struct(F.array(rec).alias("molecules"))).alias("json"))
    return IO.flatten_json_pages(pages)


@query("source_stats_report", "SELECT user_id, count(*) AS n, 'user_' || user_id || '.csv' AS file FROM events GROUP BY user_id")
def q_source_stats_report(spark, sf):
    return IO.source_stats(X.table(spark, sf, "events"), "user_id", "user_")


@query("sink_text_corpus", "SELECT md5(unnest(string_split(text, chr(10)))) AS sig FROM documents")
def q_sink_text_corpus(spark, sf):
    path = IO.scratch_path(spark, "text")
    IO.write_text_corpus(X.corpus(spark, sf), "text", path)
    return spark.read.option("lineSep", "\n").text(path).select(F.md5("value").alias("sig"))


@query("sink_split_csv", S.with_(S.LABELLED, _STRAT) + "SELECT id, toxic, split FROM ss")
def q_sink_split_csv(spark, sf):
    path = IO.scratch_path(spark, "split_csv")
    IO.write_splits(_strat(spark, sf).select("id", "toxic", "split"), path, "csv")
    return spark.read.option("header", True).schema("id bigint, toxic int, split string").csv(path).select("id", "toxic", "split")


@query("sink_vocab", S.with_(S.WORDS, _WC, VOCAB500) + "SELECT token, id FROM vocab")
def q_sink_vocab(spark, sf):
    path = IO.scratch_path(spark, "vocab")
    IO.write_vocab(_vocab500(spark, sf), path)
    back = IO.read_vocab(spark, path)
    return back.select("token", (F.col("id") + V.N_SPECIALS).cast("int").alias("id"))


@query(
    "append_result_row",
    S.with_(S.LABELLED, S.PREDICTIONS, S.EXPERIMENTS)
    + """SELECT task, tokenizer_type, mol_rep, vocab_size, n, round(score, 6) AS score, round(perplexity, 6) AS perplexity FROM experiments
UNION ALL SELECT task, tokenizer_type, mol_rep, vocab_size, n, round(score, 6), round(perplexity, 6) FROM experiments""",
)
def q_append_result_row(spark, sf):
    path = IO.scratch_path(spark, "results")
    e = X.experiments(spark, sf).select(
        "task", "tokenizer_type", "mol_rep", "vocab_size", "n", F.round("score", 6).alias("score"), F.round("perplexity", 6).alias("perplexity")
    )
    IO.append_results(e, path, ["tokenizer_type", "task"])
    IO.append_results(e, path, ["tokenizer_type", "task"])
    back = spark.read.parquet(path)
    return back.select("task", "tokenizer_type", "mol_rep", "vocab_size", "n", "score", "perplexity")


@query("sink_model_table", S.with_(S.WORDS, _WC, VOCAB500) + "SELECT token, id FROM vocab")
def q_sink_model_table(spark, sf):
    path = IO.scratch_path(spark, "model")
    IO.save_model_table(_vocab500(spark, sf), path)
    return IO.load_model_table(spark, path).select("token", "id")
