"""Operator 2, licence scans by diagonal voting, in DataFrame functions only.

Every k consecutive words of a text (k = 3) are hashed and joined to the
k-grams of a catalogue of licence texts.  A hit at word p of the text and
word t of a template votes for the diagonal p - t.  A template that stands in
the text word by word puts all its k-grams on one diagonal; one with words
put in or left out puts them on neighbouring diagonals.  Votes are counted by
(text, template, diagonal), neighbouring diagonals of a long template are
merged (up to ``DRIFT`` apart).  Merged diagonals can chain on where a text
repeats words of a template, so the span is not their whole length: from every
vote a window as long as the template may stretch (``STRETCH``) is looked at,
and the best window is a finding if the longest run of votes in it that goes
forward in text and template holds enough of the template's k-grams
(``COVERAGE``).  The k-grams themselves are compared with the hashes, so a
collision can't vote.

Short phrases (``PHRASES``) must stand consecutively: all votes on one
diagonal.  They are the base; ``TEMPLATES`` are the method's own labels.

The catalogue is fixed and small, so it is broadcast; texts are exploded
inside the map stage and only hits and one row per document are kept.  Hits
are counted before the shuffle by text.  A text's hits are bounded by its own
length, whatever source it comes from.

Defined results
* null or empty text: no words, no labels, score 0; null doc_id: kept as null
* equal rows (id and text): one result each; rows that share only the id: apart
* overlapping places of one phrase: each counts
* windows of equal worth: the first one gives the span
* words of a template repeated around a find: they don't hide it
* very long texts: rows grow with the words, each window is bounded by the catalogue
* empty table: no rows; other columns are ignored
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_az, read_table, row_key, split_words, written

K = 3
DRIFT, COVERAGE, STRETCH = 4, 0.6, 1.5
#: What stands between words; A-Z are lower-cased first.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count as base places, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Opening words of public licence texts, as words (a-z, 0-9), with the labels they give.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)


def _grams(text: str) -> list[str]:
    w = text.split(" ")
    return [" ".join(w[i : i + K]) for i in range(len(w) - K + 1)]


def _catalogue() -> list[tuple[int, str, bool, int, int]]:
    """(template, label, base, words, 1 for a template whose votes must share a diagonal)."""
    rows = [(text, label, True) for text, label in PHRASES] + [(text, label, False) for text, label in TEMPLATES]
    return [(i, text, label, base, len(text.split(" "))) for i, (text, label, base) in enumerate(rows)]


#: Templates of up to so many words must stand consecutively.
SHORT = 6


def catalogue_grams(spark: SparkSession) -> DataFrame:
    """(gram, hash, at array<(template, t)>): one row per distinct k-gram."""
    rows = [(g, i, t) for i, text, *_ in _catalogue() for t, g in enumerate(_grams(text))]
    df = spark.createDataFrame(rows, "gram string, template int, t int")
    w = F.split("gram", " ")
    return df.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("template", "t"))).alias("at")).withColumn("hash", F.xxhash64(w[0], w[1], w[2]))


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(i, label, base, n, n - K + 1) for i, _, label, base, n in _catalogue()]
    return spark.createDataFrame(rows, "template int, label string, base boolean, n_template int, n_grams int")


def licence_hits(docs: DataFrame) -> DataFrame:
    """(_k, doc_id, n_words, p, at): the first word of every row, and every k-gram that the catalogue has."""
    rows = row_key(docs.select("doc_id", "text"))
    words = rows.select("_k", "doc_id", split_words(lower_az(F.coalesce("text", F.lit(""))), GAP).alias("w"))
    each = words.select("_k", "doc_id", F.size("w").cast("bigint").alias("n_words"), F.col("w").alias("_w"), F.posexplode_outer("w").alias("p", "w0"))
    gram = ["w0", *[F.get("_w", F.col("p") + i) for i in range(1, K)]]
    grams = F.broadcast(catalogue_grams(docs.sparkSession))
    hits = each.withColumn("hash", F.xxhash64(*gram)).join(grams, "hash", "left")
    # The words themselves are compared only where the hashes agree.
    hits = hits.withColumn("at", F.when(F.col("gram").isNotNull() & (F.concat_ws(" ", *gram) == F.col("gram")), F.col("at")))
    return hits.where(F.col("at").isNotNull() | (F.coalesce("p", F.lit(0)) == 0)).select("_k", "doc_id", "n_words", F.coalesce("p", F.lit(0)).cast("bigint").alias("p"), "at")


def _window(n_template):
    """How many words may lie between the first words of a window's first and last k-gram."""
    return F.floor(n_template * F.lit(STRETCH)) + F.lit(DRIFT - K)


def _forward(ts):
    """Length of the longest strictly increasing run in an array of template places (kept: the smallest end of each length)."""

    def step(ends, t):
        shorter = F.filter(ends, lambda x: x < t)
        return F.concat(shorter, F.array(t), F.slice(ends, F.size(shorter) + 2, F.size(ends)))

    return F.size(F.aggregate(ts, F.array().cast("array<int>"), step))


def findings(hits: DataFrame) -> DataFrame:
    """(_k, template, label, base, first, last, coverage, found): the best window of every merged span, by diagonal voting."""
    cat = F.broadcast(catalogue(hits.sparkSession))
    votes = hits.where(F.col("at").isNotNull()).select("_k", "p", F.inline("at")).distinct()
    votes = votes.withColumn("diagonal", F.col("p") - F.col("t")).join(cat, "template")
    by_diagonal = Window.partitionBy("_k", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > F.when(F.col("n_template") <= SHORT, 0).otherwise(DRIFT)
    islands = votes.withColumn("_apart", F.when(apart, 1).otherwise(0)).withColumn(
        "_island", F.sum("_apart").over(by_diagonal.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    )
    widest = max(int(n * STRETCH) + DRIFT - K for *_, n in _catalogue())
    ahead = Window.partitionBy("_k", "template", "_island").orderBy("p").rangeBetween(Window.currentRow, widest)
    near = F.filter(F.collect_list(F.struct("p", (-F.col("t")).alias("back"))).over(ahead), lambda v: v["p"] <= F.col("p") + _window(F.col("n_template")))
    windows = islands.withColumn("_votes", F.array_sort(near)).withColumn("_ts", F.transform("_votes", lambda v: -v["back"]))
    short = F.col("n_template") <= SHORT
    enough = lambda n: F.when(short, n == F.col("n_grams")).otherwise(n >= F.col("n_grams") * COVERAGE)
    # Only a window with enough places of the template can have enough in order.
    run = F.when(enough(F.size(F.array_distinct("_ts"))), _forward(F.col("_ts"))).otherwise(0)
    windows = windows.withColumn("_run", run).withColumn("_last", F.array_max(F.transform("_votes", lambda v: v["p"])) + K - 1)
    best = windows.groupBy("_k", "template", "label", "base", "n_template", "n_grams", "_island").agg(
        F.max_by(F.struct("p", "_last", "_run"), F.struct("_run", -F.col("p"))).alias("b")
    )
    run = F.col("b._run")
    return best.select("_k", "template", "label", "base", F.col("b.p").alias("first"), F.col("b._last").alias("last"), (run / F.col("n_grams")).alias("coverage"), enough(run).alias("found"))


def licence_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score``: the largest share of a template's k-grams that a finding holds, 0 without one.
    """
    hits = written(licence_hits(docs), "licence-hits")
    base, found = F.col("base") & F.col("found"), F.col("found")
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    by_text = findings(hits).groupBy("_k").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(found).alias("labels"),
        F.max(F.when(found, F.col("coverage"))).alias("score"),
    )
    rows = hits.where(F.col("p") == 0).select("_k", "doc_id", "n_words")
    return rows.join(by_text, "_k", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    return licence_scan(read_table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    grams = ", ".join(f"('{g}', {i}, {t})" for i, text, *_ in _catalogue() for t, g in enumerate(_grams(text)))
    cat = ", ".join(f"({i}, '{label}', {str(base).lower()}, {n}, {n - K + 1})" for i, _, label, base, n in _catalogue())
    return rf"""
WITH grams(gram, template, t) AS (VALUES {grams}),
cat(template, label, base, n_template, n_grams) AS (VALUES {cat}),
d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (SELECT k, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS gram FROM (SELECT k, w, unnest(range(0, len(w) - {K - 1})) AS p FROM d)),
v AS (SELECT k, p, template, t FROM g JOIN grams USING (gram)),
isl AS (
  SELECT *, sum(apart) OVER (PARTITION BY k, template ORDER BY diagonal) AS island FROM (
    SELECT k, p, template, t, diagonal, label, base, n_template, n_grams,
      CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY k, template ORDER BY diagonal) > CASE WHEN n_template <= {SHORT} THEN 0 ELSE {DRIFT} END THEN 1 ELSE 0 END AS apart
    FROM (SELECT DISTINCT k, p, template, t, p - t AS diagonal FROM v) JOIN cat USING (template))),
win AS (
  SELECT a.k, a.template, a.label, a.base, a.n_template, a.n_grams, a.island, a.p AS first, a.t AS t0,
    list(b.t ORDER BY b.p, b.t DESC) AS ts, max(b.p) + {K - 1} AS last
  FROM isl a JOIN isl b ON a.k = b.k AND a.template = b.template AND a.island = b.island
    AND b.p >= a.p AND b.p <= a.p + CAST(floor(a.n_template * {STRETCH}) AS BIGINT) + {DRIFT - K}
  GROUP BY a.k, a.template, a.label, a.base, a.n_template, a.n_grams, a.island, a.p, a.t),
run AS (
  SELECT *, len(list_reduce(list_transform(ts, lambda x: [x]),
    lambda e, x: list_filter(e, lambda y: y < x[1]) || x || e[len(list_filter(e, lambda y: y < x[1])) + 2:])) AS n
  FROM win),
f AS (
  SELECT k, template, label, base, island, first, last, n / n_grams AS coverage,
    CASE WHEN n_template <= {SHORT} THEN n = n_grams ELSE n >= n_grams * {COVERAGE} END AS found
  FROM (SELECT *, row_number() OVER (PARTITION BY k, template, island ORDER BY n DESC, first) AS i FROM run) WHERE i = 1),
a AS (
  SELECT k, count(*) FILTER (WHERE base AND found) AS n_base, min(first) FILTER (WHERE base AND found) AS first_word,
    max(first) FILTER (WHERE base AND found) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND found) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found) AS labels,
    max(coverage) FILTER (WHERE found) AS score
  FROM f GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a USING (k)
"""


OP2_SQL = _op2_sql()
