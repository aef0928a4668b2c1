"""Benchmark of the headline queries.

Runs each headline query on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS] and prints one JSON line:
  {"metric": ..., "value": total_sec, "unit": "sec", "queries": {name: sec}, "sf": ...}
Each query is executed in full through the no-op sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Headline set: health (HLT-1, HLT-9, HLT-14, HLT-19), anomaly run (ANO-18), and one full
# leading-indicator cycle (score -> domains -> enterprise -> correlations -> alerts -> ETA -> outage).
HEADLINE = ["hlt1_threshold_breach", "hlt9_application_health", "hlt14_application_dashboard", "hlt19_suppress",
            "ano18_run_anomaly"]
CYCLE = ["lip3_domain_scores", "lip4_enterprise_score", "lip5_correlations", "lip8_new_alerts", "lip14_eta",
         "lip15_outage_probability"]
EXTRA = ["git1_contributions", "kpi17_call_centre", "ind3_2_poor_call_rate"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    from opsight.plans.registry import load_all
    from opsight.session import get_session

    qs, _ = load_all()
    spark = get_session(app_name="opsight-bench")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    def run(key):
        t = time.time()
        qs[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - t, 3)

    run("hlt10_weighted_error_score")  # JVM / codegen warm-up, not reported
    times = {}
    for k in HEADLINE + [k for k in EXTRA if k in qs]:
        times[k] = run(k)
    cycle = 0.0
    for k in CYCLE:
        times[k] = run(k)
        cycle += times[k]
    times["leading_indicator_cycle"] = round(cycle, 3)
    # One cycle as the job runs it: snapshots once, every stage on them.
    from opsight.plans.leading_plans import run_cycle
    t = time.time()
    for df in run_cycle(spark, sf_dir).values():
        df.write.format("noop").mode("overwrite").save()
    times["leading_indicator_cycle_job"] = round(time.time() - t, 3)
    # The whole cycle on the fourteen signals themselves: one snapshot of SIG-1..14 and every stage after it.
    from opsight.plans.cycle_plans import signal_cycle
    t = time.time()
    for df in signal_cycle(spark, sf_dir, cycles=1).values():
        df.write.format("noop").mode("overwrite").save()
    times["leading_indicator_cycle_signals"] = round(time.time() - t, 3)
    total = round(sum(v for k, v in times.items() if not k.startswith("leading_indicator_cycle")), 3)
    print(json.dumps({"metric": "headline_total_time", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": int(os.environ.get("BENCH_CPUS", "8"))}))


if __name__ == "__main__":
    main()
