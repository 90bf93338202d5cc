"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "classify_hardware_page", "normalize_hardware", "score_hardware", "first_wins_dedupe", "split_outputs", "rank_opportunities",
    "hardware_funnel", "change_history", "snapshot_diff", "status_transition", "normalize_site", "site_funnel", "site_search",
    "supplier_search", "retail_search", "radius_join", "power_screen", "geocode_lookup", "extract_criteria", "priority_pick",
    "html_text", "html_link_scan", "end_time_signals", "fn_contact", "source_health",
]


def main() -> None:
    from dealsift.catalog import all_queries
    from dealsift.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g", "spark.python.sql.dataFrameDebugging.enabled": "false",
        # the given files are one row group each; without this every query would read and parse in one task
        "dealsift.spread": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    only = sys.argv[1:] or HEADLINE
    # start the workers and the code cache before the clock
    queries["source_run_summary"](spark, sf_dir).collect()
    for name in only:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
