"""Run every registered query and summarise its final (AQE) physical plan.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shopfloor import registry  # noqa: E402
from shopfloor.session import build_session  # noqa: E402


def summary(plan: str) -> dict[str, int]:
    final = plan.split("== Initial Plan ==")[0]
    return {
        "shuffles": len(re.findall(r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange RoundRobin", final)),
        "single": len(re.findall(r"\bExchange SinglePartition", final)),
        "broadcasts": final.count("BroadcastExchange"),
        "windows": len(re.findall(r"\bWindow \[", final)),
        "scans": len(re.findall(r"FileScan parquet [^\n]*events\.parquet", final)),
        "smj": final.count("SortMergeJoin"),
        "nested_loop": final.count("BroadcastNestedLoopJoin") + final.count("CartesianProduct"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8, extra={"spark.ui.enabled": "false", "spark.sql.maxMetadataStringLength": "400"})
    spark.sparkContext.setLogLevel("ERROR")
    print(f"# Physical plans of the registered queries ({sf_dir})\n")
    print("Final AQE plans after execution (`tools/plan_report.py`), without a store. *Scans* "
          "counts scans of `events`, each parsed once; *shuffles* hash / range / round-robin "
          "exchanges: one of a scan's typed readings by (device, minute or hour), the others move "
          "segments and aggregates. *Single* counts the one-row exchanges of global aggregates "
          "(the scalar subqueries of the range and `as_of`, which read timestamps alone). No query "
          "contains a nested-loop or Cartesian join.\n")
    print("| query | scans | shuffles | single | broadcasts | windows | sort-merge joins | nested-loop |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in registry.queries().items():
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = summary(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {name} | {s['scans']} | {s['shuffles']} | {s['single']} | {s['broadcasts']} | {s['windows']} | "
              f"{s['smj']} | {s['nested_loop']} |")
    flagship = registry.queries()["oee_company"](spark, sf_dir)
    print("\n## Flagship plan (`oee_company`, `explain(\"formatted\")`)\n")
    print("```")
    print(flagship._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    print("```")


if __name__ == "__main__":
    main()
