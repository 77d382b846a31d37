"""Time the headline queries on one machine and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (comma-separated names) choose what runs. Each query runs to the
end over all its rows; nothing is kept between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from tariffscope.session import drop_staged, local_session  # noqa: E402

HEADLINE = (
    "star_join,charge_pivot,features,account_baselines,client_summary,top_spenders,compare_periods,"
    "weather_context,findings,recovery_by_client,insights_by_vendor,dashboard_flat,dashboard_nested,"
    "monthly_trend,math_audit,reject_gate,line_items_explode,bill_intake,constraint_violations,"
    "line_cleaner,document_assembly,review_bills,rf_score,detection_run"
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", HEADLINE).split(",")
    spark = local_session(cores, "bench")
    QUERIES["severity"].run(spark, folder).write.format("noop").mode("overwrite").save()  # start-up
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        drop_staged(spark)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
