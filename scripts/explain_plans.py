"""Write the final (post-AQE) physical plans of the headline queries to PLANS.md.

Usage: python scripts/explain_plans.py [sf_dir]   (default /root/testdata/sf0.1)
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from relaylake.plans import all_queries  # noqa: E402
from relaylake.session import build_session  # noqa: E402

HEADLINE = [("P1", "intake_plan"), ("P2", "stage_summary"), ("Q4", "dq_rules"), ("P6", "endpoint_audit"),
            ("C11", "plan_full")]


def shorten(plan: str) -> str:
    out = []
    for line in plan.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        out.append(line if len(line) <= 180 else line[:177] + "...")
    return "\n".join(out)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8)
    q = all_queries()
    parts = []
    for label, name in HEADLINE:
        df = q[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        parts.append(f"## {label} `{name}`\n\n```\n{shorten(plan)}\n```\n")
    spark.stop()
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.generated.md"), "w") as fh:
        fh.write(f"# Final physical plans at {os.path.basename(sf)} (generated)\n\n" + "\n".join(parts))


if __name__ == "__main__":
    main()
