"""Summarise the executed physical plan of each headline query (sf given as argument).

For every query: shuffles (Exchange), broadcasts, sort-merge joins, Window
operators, Python stages, and each Parquet scan's pruned ReadSchema and pushed
filters.  Writes markdown to stdout.
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from motorsight.plans.registry import load_all  # noqa: E402
from motorsight.session import get_spark  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", 16)
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    print("| Query | Exchanges | Broadcasts | SMJ | Windows | Python | Scans (columns read; pushed filters) |")
    print("|---|---|---|---|---|---|---|")
    for name in HEADLINE:
        df = reg[name].fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()          # final adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        ex = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
        bc = len(re.findall(r"BroadcastHashJoin|BroadcastNestedLoopJoin", plan))
        smj = plan.count("SortMergeJoin")
        win = len(re.findall(r"\bWindow \[", plan))
        py = len(re.findall(r"FlatMapGroupsInPandas|MapInPandas|ArrowEvalPython|BatchEvalPython", plan))
        scans = []
        for m in re.finditer(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan):
            scans.append(f"{len(m.group(1).split(','))} cols; {m.group(2) or '-'}")
        print(f"| {name} | {ex} | {bc} | {smj} | {win} | {py} | {' / '.join(sorted(set(scans)))} |")


if __name__ == "__main__":
    main()
