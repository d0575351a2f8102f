"""Registered queries against their DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

from spindle.plans.registry import all_oracles, all_queries
from spindle.sources.fixtures import TABLES

SF_SMALL = "/root/testdata/sf0.001"

KEYS = [
    "structural_alerts", "alerts_per_task", "count_tokens", "vocab_atomwise", "vocab_from_merges", "encode_ids",
    "encode_pair", "mlm_mask", "dedupe_keep_first", "validate_quarantine", "similarity_self_join", "random_split",
    "stratified_split", "group_disjoint_split", "bootstrap_ci", "m_all", "m_auc_delong", "roc_curve", "pr_curve_auc",
    "midrank_weighted", "bucket_counts", "ngram_lm", "corpus_perplexity", "log_odds_scorer", "explain_all_methods",
    "q_faithfulness", "q_reiteration", "r_optimal_by_task", "sink_vocab", "scan_split_tables", "flatten_json_pages",
    "dictionary_group_counts", "tokenizer_profile", "perturb_replace_token",
]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = all_queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(all_oracles()[key])
    drows = cur.fetchall()
    assert _canon(df.columns, srows) == _canon([d[0] for d in cur.description], drows)


def test_every_query_has_a_builder_and_oracles_are_subset():
    q, o = all_queries(), all_oracles()
    assert set(o) <= set(q)
    assert len(q) >= 150
