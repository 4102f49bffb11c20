"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.registry import catalogue
from barloom.session import local_session

HEADLINE = [
    "high_low_52_week", "close_vs_52w_range", "cross_section_momentum", "tier1_features", "tier1_candidates",
    "technical_indicators", "next_day_signal", "pct_rank_daily", "prob_mapper", "daily_top_n", "fold_metrics",
    "variance_scores", "backtest_metrics", "upsert_merge", "symbol_search", "daily_payload",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="barloom-bench")
    known = catalogue()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors before timing
    times = {}
    for name in names:
        start = time.perf_counter()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
