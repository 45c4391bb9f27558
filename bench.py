"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``: one warm-up run is discarded, then the median of
``$BENCH_RUNS`` (default 5) timed runs is reported. Each run executes the
whole plan into Spark's ``noop`` sink, so nothing is collected to the
driver. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import platform
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from relaylake.plans import all_queries  # noqa: E402
from relaylake.session import build_session  # noqa: E402

HEADLINE = {
    "P1_intake_plan": "intake_plan",
    "P2_stage_summary": "stage_summary",
    "Q4_dq_rules": "dq_rules",
    "P6_endpoint_audit": "endpoint_audit",
    "C11_plan_full": "plan_full",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = build_session(f"local[{cpus}]", max(cpus, 8), app_name="relaylake-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                                 "relaylake.scan.partitions": str(cpus)})  # the tables are one row group each
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="relaylake-bench-"))
    q = all_queries()
    out = {}
    for label, name in HEADLINE.items():
        times = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i:  # the first run warms the JVM and the file cache
                times.append(dt)
        out[label] = round(statistics.median(times), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_median_total",
        "value": round(sum(out.values()), 3),
        "unit": "sec",
        "queries": out,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
        "host": platform.node(),
    }))


if __name__ == "__main__":
    main()
