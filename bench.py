"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose the input and the
cores. Every query runs to its last row into a sink that keeps nothing. ``python bench.py --reads``
prints instead, per query, what its scan reads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.plans.queries import all_queries  # noqa: E402
from tidewatch.session import local_session  # noqa: E402

HEADLINE = [
    "engineer_features", "clean_rows", "describe_numeric", "describe_lineitem", "medians", "standard_scale", "encoded_matrix",
    "stratified_split", "kfold_assign", "correlation_lineitem", "mutual_info_binned", "headline_metrics", "auc_ovr",
    "alert_messages", "throttle_alerts", "throttle_decisions", "running_totals", "rolling_per_row", "rolling_stats",
    "stream_alerts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = all_queries()
    if "--reads" in sys.argv:
        for name in HEADLINE:
            plan = queries[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
            print(name, [line.strip()[:300] for line in plan.splitlines() if "FileScan" in line][:2])
        return
    queries["batch_summary"](spark, folder).collect()  # starts the JVM's workers and compilers
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale,
    }))


if __name__ == "__main__":
    main()
