"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

import json
import os
import time

from tidemark.plans import QUERIES, run
from tidemark.session import build_session

HEADLINE = (
    "a3_server_index", "a2_group_index", "a4_price_profile", "a6_sidebar_groups", "a7_ohlc_bars",
    "a8_rollup_5m", "a10_rollup_1d", "a14_market_stats", "j1_alias_lookup", "j17_fx_conversion",
    "j22_profile_fallback", "n2_bracket_title", "p1_price_per_1k", "s7_listing_items",
    "v_clean_offers", "w1_dedup", "w2_moving_average", "w3_pinned_list", "w4_top_five",
    "w6_change_throttle", "d1_volume_median", "d4_outlier_filter",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run("a13_source_summary", spark, folder).collect()  # starts the JVM's workers, not timed
    seconds = {}
    for name in HEADLINE:
        assert name in QUERIES
        started = time.perf_counter()
        run(name, spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
