"""Time the headline queries (with BENCH_ALL=1 all of them) and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the data, BENCH_CPUS (default 8) the number of local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from larder.queries import QUERIES
from larder.session import local_session, remove_run_folder

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = [
    "clean_daily_demand", "model_input_view", "fact_refresh_window", "canonical_mapping", "staged_sales", "constraint_report",
    "forecast_features", "baseline_forecast", "rolling_backtest", "serving_view", "health_report", "order_totals",
    "session_history", "order_edit", "cart_items_clean", "cart_diff", "cart_merge", "cart_fold", "cart_checkout", "menu_tree",
    "menu_with_sets", "enriched_candidates", "demand_top3", "menu_avoid", "html_text", "keyword_windows", "url_corpus",
    "vector_search", "stream_cart_changes", "stream_session_counts",
]
SMALLER = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    """Every query runs on the smaller data first, which warms it up, and then on the data that counts.

    ``BENCH_RUNS`` (default 1) more runs give the median; the ratio tells what ten times the rows cost.
    """
    spark = local_session("bench")
    more = int(os.environ.get("BENCH_RUNS", "1"))
    seconds, ratio = {}, {}
    for name in sys.argv[1:] or (sorted(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE):
        small = timed(spark, name, SMALLER)
        seconds[name] = round(statistics.median(timed(spark, name, FOLDER) for _ in range(max(1, more))), 3)
        ratio[name] = round(seconds[name] / max(small, 0.001), 2)
    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale) if scale.replace(".", "").isdigit() else scale, "ratio_to_smaller": ratio,
    }
    print(json.dumps(line))
    remove_run_folder(spark)
    spark.stop()


if __name__ == "__main__":
    main()
