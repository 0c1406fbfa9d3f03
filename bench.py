"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_WARM_DIR (default /root/testdata/sf0.01: an untimed run of the same
queries first, so the timed run measures steady state, not JIT warm-up).
Each query runs BENCH_RUNS times (default 3; the median counts) into Spark's
``noop`` sink (nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["token_spans", "align_tokens", "reaching_defs", "merge_branches", "pool_mean", "doc_flags",
            "first_occurrence_edges", "hash_vectors"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from spanflow.plans.registry import load_all_plans
    from spanflow.session import get_spark
    spark = get_spark(cpus, app="spanflow-bench")
    Q, _ = load_all_plans()
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    for name in HEADLINE:                    # JIT warm-up on the sf0.01 tables, not timed
        Q[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            t0 = time.time()
            Q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - t0)
        times[name] = round(statistics.median(took), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
