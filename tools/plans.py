"""Print what to look at in the physical plan of each query: ``plans.py folder [name ...]``."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from somnia.plans import load  # noqa: E402
from somnia.plans.registry import Tables  # noqa: E402
from somnia.session import build_session  # noqa: E402

WATCH = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ObjectHashAggregate", "SortAggregate", "ArrowEvalPython",
         "Exchange SinglePartition", "Exchange hashpartitioning", "Exchange rangepartitioning", "FileScan"]


def main(folder, names):
    spark = build_session("plans", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    for name, q in load().items():
        if names and name not in names:
            continue
        df = q.build(Tables(spark, folder))
        plan = df._jdf.queryExecution().executedPlan().toString()
        if names:
            print(plan)
        found = {w.replace("Exchange ", ""): plan.count(w) for w in WATCH if w in plan}
        print(name, found, f"windows {plan.count('Window [')}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
