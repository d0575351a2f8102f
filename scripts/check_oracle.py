"""Run registered Spark queries and their DuckDB oracle SQL side by side.

usage: python scripts/check_oracle.py [sf_dir] [key-substring ...]
Prints one line per key: status, rows (spark/duckdb), seconds.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from spindle.plans.registry import all_oracles, all_queries  # noqa: E402
from spindle.session import local_session  # noqa: E402
from spindle.sources.fixtures import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, orc = all_queries(), all_oracles()
    bad = 0
    skip = set(filter(None, os.environ.get("CHECK_SKIP", "").split(",")))
    for k, fn in qs.items():
        if k in skip or (pats and not any(p in k for p in pats)):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"SPARK-ERR {k}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in orc:
            print(f"rows-only {k}: {len(srows)} rows {ts:.1f}s")
            continue
        try:
            cur = con.execute(orc[k])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"DUCK-ERR {k}: {str(e)[:400]}")
            bad += 1
            continue
        a, b = canon(scols, srows), canon(dcols, drows)
        ok = a == b
        if not ok:
            bad += 1
            print(f"MISMATCH {k}: spark {len(srows)} rows cols {a[0]} / duck {len(drows)} rows cols {b[0]} {ts:.1f}s")
            sa, sb = set(a[1]), set(b[1])
            print("   spark-only:", list(sa - sb)[:3])
            print("   duck-only: ", list(sb - sa)[:3])
        else:
            print(f"ok {k}: {len(srows)} rows {ts:.1f}s")
    print(f"done, {bad} problems")
    spark.stop()


if __name__ == "__main__":
    main()
