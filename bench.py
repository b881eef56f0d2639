"""Benchmark of the headline queries.

Runs each query fully (``noop`` sink: every row computed, nothing collected) at
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and
prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.plans import fixtures as FX  # noqa: E402
from riskloom.plans.registry import QUERIES  # noqa: E402
from riskloom.session import local_session  # noqa: E402

HEADLINE = ["weekly_metrics", "weekly_metrics_range", "weekly_metrics_join", "weekly_metrics_global",
            "weekly_median", "forecast_table", "forecast_table_all", "som_train", "country_risk", "select_relaxed", "select_exact"]


def plan_shape(df) -> dict:
    """Scans and exchanges of the query's physical plan (the last action of the query;
    steps materialised earlier are separate, smaller plans)."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return {"scans": len(re.findall(r"(FileScan|Scan parquet|Scan ExistingRDD|Scan csv|Scan json)", text)),
            "shuffles": len(re.findall(r"\bExchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", text)),
            "broadcasts": text.count("BroadcastExchange")}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="riskloom-bench", shuffle_partitions=max(cpus * 2, 8))
    FX.events(spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM and file-cache warm-up
    times, plans = {}, {}
    for name in names:
        runs = []
        while len(runs) < (4 if not runs or runs[0] < 10 else 2):
            # the first run warms up; the median of three counts, of long queries the second run
            t0 = time.time()
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        times[name] = round(sorted(runs[1:])[(len(runs) - 1) // 2], 3)
        plans[name] = plan_shape(df)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "plans": plans}))
    spark.stop()


if __name__ == "__main__":
    main()
