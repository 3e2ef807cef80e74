"""Local correctness check: run each registered query on Spark and its
oracle SQL on DuckDB over the same parquet files; compare row count,
column names and an order-insensitive hash of the values.

    python -m triage.plans.check [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import sys
import time

import duckdb

from triage.plans.registry import oracle_sql, queries
from triage.session import get_spark

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "<NULL>"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = True
    sqls = oracle_sql()
    for name, fn in queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf)
        cols = df.columns
        rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        if name not in sqls:
            print(f"{name:28s} spark_rows={len(rows):7d} (no oracle) {t1 - t0:.1f}s")
            continue
        res = con.execute(sqls[name])
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        h1, l1 = digest(rows, cols)
        h2, l2 = digest(orows, ocols)
        same = sorted(cols) == sorted(ocols) and h1 == h2
        ok &= same
        print(f"{name:28s} {'OK ' if same else 'BAD'} spark={len(rows)} oracle={len(orows)} {t1 - t0:.1f}s")
        if not same:
            if sorted(cols) != sorted(ocols):
                print("   cols", cols, ocols)
            s1, s2 = set(l1), set(l2)
            for x in sorted(s1 - s2)[:3]:
                print("   spark only :", x[:300])
            for x in sorted(s2 - s1)[:3]:
                print("   oracle only:", x[:300])
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
