"""Summarise the physical plans of the headline queries into PLANS.md.

For each query: shuffles (Exchange), broadcasts, join strategies, aggregates,
generators and, per scan, the pruned read schema and pushed filters.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from icx.plans import catalog  # noqa: E402
from icx.session import local_session  # noqa: E402


def summarise(plan: str) -> dict:
    ops = re.findall(r"^\(\d+\) (.+)$", plan, flags=re.M)
    scans = re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:.*\n)*?ReadSchema: ([^\n]+)", plan)
    pushed = re.findall(r"PushedFilters: (\[[^\n]*\])", plan)
    return {
        "shuffles": sum(1 for o in ops if o.strip() == "Exchange"),
        "broadcasts": sum(1 for o in ops if o.strip() == "BroadcastExchange"),
        "joins": sorted({o.strip() for o in ops if "Join" in o}),
        "aggregates": sum(1 for o in ops if "HashAggregate" in o),
        "generate": sum(1 for o in ops if o.strip() == "Generate"),
        "read_schemas": scans,
        "pushed_filters": pushed,
    }


def main(sf_dir: str, out: str) -> None:
    spark = local_session()
    lines = ["# Physical plans of the headline queries", "",
             f"Generated by `tools/plan_summary.py` at `{sf_dir}` (pre-AQE plans; AQE may still turn a",
             "sort-merge join into a broadcast or split skewed partitions at run time).", ""]
    for name in HEADLINE:
        df = catalog.QUERIES[name](spark, sf_dir)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        s = summarise(plan)
        lines.append(f"## {name}")
        lines.append(f"- shuffles: {s['shuffles']}, broadcasts: {s['broadcasts']}, hash aggregates: {s['aggregates']}, "
                     f"generators: {s['generate']}")
        lines.append(f"- joins: {', '.join(s['joins']) or 'none'}")
        for rs in sorted(set(s["read_schemas"])):
            lines.append(f"- scan ReadSchema: `{rs}`")
        for pf in sorted(set(p for p in s["pushed_filters"] if p != "[]")):
            lines.append(f"- PushedFilters: `{pf}`")
        lines.append("")
    with open(out, "w") as f:
        f.write("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1", sys.argv[2] if len(sys.argv) > 2 else "PLANS.md")
