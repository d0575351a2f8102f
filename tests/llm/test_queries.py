"""The registered queries against their DuckDB SQL, and their columns."""

import duckdb
import pytest

from spindle.llm.queries import llm_oracles, llm_queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op2": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op3": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op5": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7": "page_id bigint, record_type string, record_id string, refers_to string",
    "op8": "doc_id bigint, n_words bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op10": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op11": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op12": "doc_id bigint, fingerprint string, component_id bigint",
    "op13": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
}


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_query(spark, name):
    df = llm_queries()[name](spark, SF)
    for column in COLUMNS[name.split("_")[0]].split(", "):
        assert tuple(column.split(" ")) in df.dtypes
    got = df.collect()
    assert got
    if name in llm_oracles():
        con = duckdb.connect()
        for t in "documents embeddings conversations".split():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        cur = con.execute(llm_oracles()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(repr([norm(x) for x in r]) for r in cur.fetchall())
        assert sorted(repr([norm(r[c]) for c in names]) for r in got) == want
    elif name.split("_")[0] in ("op3", "op5", "op6", "op9", "op11", "op12"):
        assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
