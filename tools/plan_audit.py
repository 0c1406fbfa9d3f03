"""Count shuffles, broadcasts, joins and windows in each registered query's
physical plan (static AQE plan; exchanges that AQE reuses at run time are
counted twice here).  usage: python tools/plan_audit.py [--sf DIR]"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanflow.plans.registry import load_all_plans  # noqa: E402
from spanflow.session import get_spark  # noqa: E402

SF = sys.argv[sys.argv.index("--sf") + 1] if "--sf" in sys.argv else "/root/testdata/sf0.01"
SKIP = {"probe_logistic", "probe_summary", "probe_multi", "probe_addition"}   # fit models while planning

spark = get_spark(8)
Q, _ = load_all_plans()
for n, f in Q.items():
    if n in SKIP:
        continue
    p = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
    ex = len(re.findall(r"Exchange (hash|range|Single|Round)", p))
    print(f"{n:24s} exch={ex} bcast={p.count('BroadcastExchange')} smj={p.count('SortMergeJoin')} "
          f"bhj={p.count('BroadcastHashJoin')} nlj={p.count('NestedLoop')} win={p.count('Window ')}")
