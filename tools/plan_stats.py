"""Print shuffle / broadcast / window / python-UDF counts of each registered query's plan.

usage: python tools/plan_stats.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larder.plans.registry import QUERIES, load_all  # noqa: E402
from larder.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # static plan: what a cluster starts from
    load_all()
    for name in sys.argv[2:] or sorted(QUERIES):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        c = lambda pat: len(re.findall(pat, plan))
        print(f"{name:28s} exchange={c(r'Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin'):2d} "
              f"reused={c(r'ReusedExchange'):2d} broadcast={c(r'BroadcastExchange'):2d} smj={c(r'SortMergeJoin'):2d} "
              f"window={c(r'Window '):2d} groupLimit={c(r'WindowGroupLimit'):2d} python={c(r'ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas'):2d} "
              f"nlj={c(r'NestedLoopJoin|CartesianProduct'):2d} single={c(r'SinglePartition'):2d}")


if __name__ == "__main__":
    main()
