"""Times headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names, default the list below).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "score_report",
    "accuracy_report",
    "trajectory_report_lines",
    "clustered_stderr_lines",
    "stability_report",
    "aggregate_metrics",
    "median",
    "group_report",
    "score_responses",
    "score_time_point",
    "prediction_index",
    "apply_filters",
    "expand_steps",
    "build_requests",
    "rolling_windows",
    "split_contamination",
    "bleu",
    "chrf",
    "bootstrap_stderr",
    "usage_report",
    "budget_cutoff",
    "reuse_responses",
    "merge_audit",
    "task_hash",
    "clip_manifest",
    "live_accuracy",
]


def main() -> None:
    from tallyframe.plans import QUERIES
    from tallyframe.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(f"local[{cpus}]", int(cpus), "bench")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", folder)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
