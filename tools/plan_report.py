"""Per query: scans, exchanges, broadcasts and Python stages of the plan, and any join that pairs every row with every row.

usage: python tools/plan_report.py [--sf 0.001] [name ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larder.session import local_session  # noqa: E402

MARKS = {
    "scans": r"\bFileScan\b", "exchanges": r"(?<!Broadcast)(?<!Reused)Exchange (hash|range|Round|Single)", "broadcasts": r"BroadcastExchange",
    "python": r"(ArrowEvalPython|MapInPandas|MapInArrow|FlatMapGroupsInPandas)", "single": r"Exchange SinglePartition",
    "nested": r"(BroadcastNestedLoopJoin|CartesianProduct)",
}


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.001")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    from larder.queries import QUERIES

    spark = local_session("plans")
    for name in a.names or QUERIES:
        df = QUERIES[name](spark, f"/root/testdata/sf{a.sf}")
        text = df._jdf.queryExecution().executedPlan().toString()
        counts = {k: len(re.findall(m, text)) for k, m in MARKS.items()}
        print(f"{name:26s} " + " ".join(f"{k}={v}" for k, v in counts.items() if v), flush=True)
        for line in text.splitlines():
            if re.search(MARKS["nested"], line):
                print("    " + line.strip(" :+-")[:220])


if __name__ == "__main__":
    main()
