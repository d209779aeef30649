"""Summarise the executed physical plans of the headline queries (writes PLANS.md).

For each query: shuffles (Exchange), join strategies, aggregate kinds,
window limits, pushed filters, partition filters and scanned columns, taken
from the final adaptive plan after one run on the stored-table layout and on
the derived views.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from carrierbook.plans import catalog  # noqa: E402
from carrierbook.session import build_session  # noqa: E402
from carrierbook.sources.fixtures import load_tables, store_tables  # noqa: E402

JOINS = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct"]


def summary(plan: str) -> dict:
    out = {
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "joins": {j: plan.count(j + " ") + plan.count(j + "(") for j in JOINS if j in plan},
        "partial_aggregates": len(re.findall(r"partial_", plan)) > 0,
        "window_group_limit": "WindowGroupLimit" in plan,
        "top_k": "TakeOrderedAndProject" in plan,
        "checkpoint_scan": "Scan ExistingRDD" in plan,
    }
    out["pushed_filters"] = sorted(set(m for m in re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))[:3]
    out["partition_filters"] = sorted(set(m for m in re.findall(r"PartitionFilters: \[([^\]]+)\]", plan)))[:2]
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8, app_name="carrierbook-plans")
    table_dir = os.path.join(tempfile.mkdtemp(prefix="carrierbook-plans-"), "tables")
    store_tables(catalog.ledger_for(spark, sf_dir), table_dir)
    stored = load_tables(spark, table_dir)
    print("# Executed plans of the headline queries\n")
    print(f"Generated by `tools/plan_report.py` from `{sf_dir}` on local[8] (final adaptive plans after one run).")
    print("\"stored\" reads the ledger tables stored with `fixtures.LAYOUT`; \"derived\" derives them from the driver")
    print("tables inside the query.\n")
    print("| Query | Input | Shuffles | Broadcasts | Joins | Partial agg | WindowGroupLimit | Top-k | Checkpoint input | Partition filters |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    details = []
    for name in HEADLINE:
        for label, make in (("stored", lambda n: catalog.run_on(stored, n)), ("derived", lambda n: catalog.run(spark, sf_dir, n))):
            df = make(name)
            df.write.format("noop").mode("overwrite").save()
            plan = df._jdf.queryExecution().executedPlan().toString()
            s = summary(plan)
            joins = ", ".join(f"{k}×{v}" for k, v in s["joins"].items()) or "—"
            print(f"| {name} | {label} | {s['exchanges']} | {s['broadcasts']} | {joins} | {'yes' if s['partial_aggregates'] else '—'} | "
                  f"{'yes' if s['window_group_limit'] else '—'} | {'yes' if s['top_k'] else '—'} | "
                  f"{'yes' if s['checkpoint_scan'] else '—'} | {'; '.join(s['partition_filters']) or '—'} |")
            if label == "stored":
                details.append((name, s["pushed_filters"]))
    print("\n## Filters pushed into the Parquet scans (stored input)\n")
    for name, pf in details:
        print(f"- **{name}**: " + ("; ".join(f"`{p[:160]}`" for p in pf) if pf else "—"))
    spark.stop()


if __name__ == "__main__":
    main()
