"""Registered queries: cleaning, projections, filters."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import clean as C
from ..operators import vocab as V
from ..sources import fixtures as X
from . import sql as S
from .q_tokens import _WC, VOCAB500, _vocab500, _words
from .registry import query


def _docs(spark, sf):
    return X.table(spark, sf, "documents").withColumnRenamed("doc_id", "id")


@query(
    "dedupe_keep_first",
    """SELECT doc_id AS id, lang, source, n_chars FROM
  (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def q_dedupe_keep_first(spark, sf):
    d = _docs(spark, sf).select("id", "text", "lang", "source", "n_chars")
    return C.dedupe_keep_first(d, ["text"], "id").select("id", "lang", "source", "n_chars")


@query(
    "drop_nulls",
    """SELECT d.doc_id AS id, d.lang, l.toxic, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.lang IS NOT NULL AND l.toxic IS NOT NULL AND l.quality IS NOT NULL""",
)
def q_drop_nulls(spark, sf):
    d = _docs(spark, sf).select("id", "lang")
    lab = X.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "toxic", "quality")
    return C.drop_nulls(d.join(lab, "id", "left"))


@query("project_columns", "SELECT doc_id, lang, n_chars FROM documents")
def q_project_columns(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")


@query("rename_columns", "SELECT doc_id AS id, n_chars AS length, lang AS language FROM documents")
def q_rename_columns(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return d.withColumnsRenamed({"doc_id": "id", "n_chars": "length", "lang": "language"})


@query(
    "labels_to_columns",
    """SELECT doc_id AS id, lab[1] AS quality, lab[2] AS toxic FROM
  (SELECT l.doc_id, [CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE)] AS lab FROM labels l JOIN documents d ON d.doc_id = l.doc_id)""",
)
def q_labels_to_columns(spark, sf):
    t = X.task_labels(spark, sf)
    return t.select("id", *[F.col("labels")[i].alias(name) for i, name in enumerate(["quality", "toxic"])])


@query(
    "unpivot_tasks",
    "SELECT doc_id, 'quality' AS task, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic' AS task, toxic AS label FROM labels",
)
def q_unpivot_tasks(spark, sf):
    lab = X.table(spark, sf, "labels")
    tasks = [c for c in lab.columns if c != "doc_id"]
    return lab.unpivot(["doc_id"], tasks, "task", "label")


@query(
    "validate_quarantine",
    f"""SELECT id, reason, reason IS NULL AS ok FROM (SELECT doc_id AS id, CASE
  WHEN array_to_string(regexp_extract_all(lower(text), '{S.TEXT_RE}', 1), '') <> regexp_replace(lower(text), '\\s', '', 'g') THEN 'not_lexable'
  WHEN length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', ''))
    OR length(text) - length(replace(text, '[', '')) <> length(text) - length(replace(text, ']', '')) THEN 'unbalanced_brackets'
  WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) % 2 <> 0 THEN 'odd_ring_digits' END AS reason FROM documents)""",
)
def q_validate_quarantine(spark, sf):
    v = C.validate_quarantine(X.corpus(spark, sf))
    return v.select("id", "reason", "ok")


@query(
    "clean_strings",
    """SELECT doc_id AS id, md5(c) AS sig, length(text) - length(c) AS n_removed FROM
  (SELECT doc_id, text, replace(replace(replace(trim(text), '\\\\', '\\'), '\\', ''), '*', '') AS c FROM documents)""",
)
def q_clean_strings(spark, sf):
    d = X.corpus(spark, sf).select("id", "text", C.clean_string("text").alias("c"))
    return d.select("id", F.md5("c").alias("sig"), (F.length("text") - F.length("c")).alias("n_removed"))


@query("filter_label", S.with_(S.LABELLED) + "SELECT id, lang FROM labelled WHERE toxic = 1")
def q_filter_label(spark, sf):
    return X.labelled(spark, sf).where(F.col("toxic") == 1).select("id", "lang")


@query(
    "filter_known_tokens",
    S.with_(S.WORDS, _WC, VOCAB500)
    + """SELECT doc_id AS id FROM documents d WHERE NOT contains(text, '\\')
  AND NOT EXISTS (SELECT 1 FROM words w LEFT JOIN vocab v ON v.token = w.token WHERE w.id = d.doc_id AND v.id IS NULL)""",
)
def q_filter_known_tokens(spark, sf):
    ids = V.lookup_ids(_words(spark, sf), _vocab500(spark, sf))
    return C.filter_known_tokens(X.corpus(spark, sf), ids, "id", V.UNK_ID).select("id")


@query(
    "filter_isin",
    "SELECT doc_id AS id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def q_filter_isin(spark, sf):
    toxic = X.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return _docs(spark, sf).select("id", "lang").join(toxic, "id", "left_semi")


@query(
    "relabel_values",
    """SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' ELSE lang END AS language,
  CASE source WHEN 'src0' THEN 'baseline' ELSE source END AS source FROM documents""",
)
def q_relabel_values(spark, sf):
    d = _docs(spark, sf)
    return d.select(
        "id",
        C.relabel("lang", {"en": "english", "fr": "french"}).alias("language"),
        C.relabel("source", {"src0": "baseline"}).alias("source"),
    )


@query(
    "format_metrics",
    S.with_(S.LABELLED, S.PREDICTIONS) + "SELECT id, round(p, 3) AS p3, round(l1, 3) AS l1_3, round(p * 1000) AS p_milli FROM predictions",
)
def q_format_metrics(spark, sf):
    p = X.predictions(spark, sf)
    return p.select("id", F.round("p", 3).alias("p3"), F.round("l1", 3).alias("l1_3"), F.round(F.col("p") * 1000).alias("p_milli"))



