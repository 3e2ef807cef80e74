"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (end-to-end seconds), "unit",
"queries" {name: median seconds}, "sf", "cpus", "runs"}.  Each query is
run once to warm up, then timed ``BENCH_RUNS`` times (median); a run
forces the full result with a no-op write-free aggregate over all rows.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from triage.plans.registry import queries  # noqa: E402
from triage.session import get_spark  # noqa: E402

HEADLINE = [
    "alerts_network", "alerts_dns", "alerts_process", "alerts_lateral", "alerts_injection",
    "hidden_processes", "alerts_persistence", "typed_table", "parse_errors", "validate_report",
    "process_lineage", "connection_owner", "alert_summary",
]


def force(df) -> int:
    """Materialise every column of every row (hash of all columns)."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.select(F.xxhash64(*cols).alias("h")).agg(F.count("h"), F.bit_xor("h")).collect()[0][0]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_spark(f"local[{cpus}]", app="triage-bench", shuffle_partitions=int(cpus) * 2)
    reg = queries()
    names = only or [q for q in HEADLINE if q in reg]
    times = {}
    for name in names:
        force(reg[name](spark, sf_dir))
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            force(reg[name](spark, sf_dir))
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "end_to_end_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus), "runs": runs,
    }))


if __name__ == "__main__":
    main()
