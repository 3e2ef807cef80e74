"""Write the executed (AQE final) physical plan shape of key queries:
operators, join strategies, exchanges, scans with their read schema and
pushed filters; long expressions are cut.

    python -m triage.plans.explain [sf_dir] > PLANS.md
"""

from __future__ import annotations

import re
import sys

from triage.plans.registry import queries
from triage.session import get_spark

KEY = ["alerts_network", "alerts_lateral", "hidden_processes", "typed_table", "validate_relations",
       "path_resolution", "inventory"]
KEEP = re.compile(r"(Exchange|Join|Aggregate|Scan|Generate|Window|TakeOrdered|Sort |Filter|BroadcastExchange|"
                  r"ArrowEvalPython|Union|AQEShuffleRead|ReusedExchange|WholeStageCodegen|\*\()")


def shape(plan: str) -> list[str]:
    out = []
    if "== Initial Plan ==" in plan:
        plan = plan.split("== Initial Plan ==")[0]
    for line in plan.splitlines():
        if not re.match(r"^[ :+|*\-]*[+*]-|^\s*\*\(|^[A-Z]", line):
            continue
        if not KEEP.search(line):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        m = re.search(r"(ReadSchema: struct<[^>]*>)", line)
        pf = re.search(r"(PushedFilters: \[[^\]]*\])", line)
        head = line[:110]
        if m or pf:
            head = line[:line.find("FileScan") + 30] if "FileScan" in line else head
            head += " ... " + " ".join(x.group(1)[:120] for x in (pf, m) if x)
        out.append(head.rstrip())
    return out


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=16)
    reg = queries()
    print(f"# Physical plans (AQE final plans, {sf}, local[8])\n")
    print("Generated by `python -m triage.plans.explain`; expressions elided.\n")
    for name in KEY:
        df = reg[name](spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"## {name}\n\n```")
        print("\n".join(shape(plan)))
        print("```\n")


if __name__ == "__main__":
    main(sys.argv)
