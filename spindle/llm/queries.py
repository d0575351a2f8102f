"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat, crf, licences, neardup, packing, pii, rules, simhash, topk, trie, warc

_QUERIES = {
    "op1_topk_search": topk.op1_topk_search,
    "op2_licence_scan": licences.op2_licence_scan,
    "op3_line_crf": crf.op3_line_crf,
    "op4_chat_format": chat.op4_chat_format,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_bpe_codec": bpe.op6_bpe_codec,
    "op7_warc_derivatives": warc.op7_warc_derivatives,
    "op8_host_rules": rules.op8_host_rules,
    "op9_personal_data": pii.op9_personal_data,
    "op10_pack_documents": packing.op10_pack_documents,
    "op11_pair_bitmaps": alignment.op11_pair_bitmaps,
    "op12_simhash_blocks": simhash.op12_simhash_blocks,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
_ORACLES = {
    "op1_topk_search": topk.OP1_SQL,
    "op2_licence_scan": licences.OP2_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op8_host_rules": rules.OP8_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def llm_oracles() -> dict[str, str]:
    return {k: v.strip() for k, v in _ORACLES.items()}
