"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (full execution, no
collect to the driver).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillsight.plans.catalog import REGISTRY  # noqa: E402
from tillsight.session import get_session  # noqa: E402

HEADLINE = [
    "top_items_revenue", "top_items_per_store", "performance_tags", "item_badges", "category_share",
    "insights", "monthly_trend", "compare_panels_old", "full_comparison", "compare_successive_periods",
    "summary_document", "prompt_focus", "ingest_csv_lines", "quality_report", "reply_parse",
    "reply_validate", "event_frames", "latest_status", "reply_progress", "duplicate_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=2 * cpus,
                        extra={"spark.driver.memory": "16g",
                               "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)})
    # warm-up: JIT and catalog caches
    REGISTRY["totals"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        fn = REGISTRY[name][0]
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
