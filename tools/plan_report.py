"""Execute every registered batch query and summarise its final adaptive
plan: shuffles, join strategies, aggregation kinds, windows, scans.

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = {
    "shuffles": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin",
    "single_partition": r"Exchange SinglePartition",
    "broadcasts": r"BroadcastExchange",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "bnlj": r"BroadcastNestedLoopJoin",
    "cartesian": r"CartesianProduct",
    "hash_agg": r"HashAggregate\(",
    "sort_agg": r"SortAggregate\(",
    "obj_agg": r"ObjectHashAggregate\(",
    "windows": r"\bWindow \[|\bWindow\(",
    "scans": r"FileScan parquet",
    "reused": r"ReusedExchange",
}


def summarise(plan: str) -> dict:
    return {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from cartwheel.session import build_session
    from cartwheel.plans.registry import QUERIES
    spark = build_session()
    print(f"# Physical plans ({sf_dir}, final adaptive plans)\n")
    print("Generated by `tools/plan_report.py`. Counts are operators in the final plan after AQE; "
          "`shuffles` counts hash/range/single-partition exchanges (single_partition separately), "
          "`pushed` lists the scans' pushed filters.\n")
    cols = list(PATTERNS)
    print("| query | " + " | ".join(cols) + " | pushed |")
    print("|---|" + "---|" * (len(cols) + 1))
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("\n+- == Initial Plan ==")[0]    # outer final adaptive plan only
        s = summarise(plan)
        pushed = sorted(set(x for x in re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + f" | {'; '.join(pushed)[:120]} |")
    # Appendix: the flagship query's full formatted plan (cart events -> fold ->
    # priced lines -> totals), as Spark prints it before execution.
    flagship = QUERIES["cart_totals"](spark, sf_dir)
    text = flagship._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    print("\n## Appendix: flagship plan (cart_totals), formatted\n")
    print("```")
    print(text.strip())
    print("```")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
