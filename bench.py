"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully computed with the ``noop`` sink (no driver collect).
Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "structural_alerts",
    "alerts_per_task",
    "count_tokens",
    "token_frequencies",
    "vocab_atomwise",
    "encode_ids",
    "truncate_pad",
    "dedupe_keep_first",
    "similarity_self_join",
    "random_split",
    "group_disjoint_split",
    "m_all",
    "roc_curve",
    "ngram_lm",
    "corpus_perplexity",
    "log_odds_scorer",
    "explain_all_methods",
    "q_faithfulness",
    "learn_bpe",
    "tokenizer_profile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from spindle.plans.registry import all_queries
    from spindle.session import local_session

    spark = local_session(cpus, "spindle-bench")
    qs = all_queries()
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    times = {}
    for name in only or HEADLINE:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total_wall",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
