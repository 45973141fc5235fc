"""List physical-plan features of every registered query: cross joins, global windows, Python stages, exchanges.

usage: plan_audit.py [--sf DIR] [key ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leafmill.registry import load_all  # noqa: E402
from leafmill.session import get_spark  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    spark = get_spark("leafmill-tools", "8")
    spark.sparkContext.setLogLevel("ERROR")
    qs = load_all()
    for key in a.keys or qs:
        plan = qs[key](spark, a.sf)._jdf.queryExecution().executedPlan().toString()
        flags = []
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "MapInPandas", "FlatMap", "SinglePartition"):
            n = plan.count(word)
            if n:
                flags.append(f"{word}={n}")
        n_ex = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin", plan))
        print(f"{key:26s} exchanges={n_ex:3d} {' '.join(flags)}", flush=True)


if __name__ == "__main__":
    main()
