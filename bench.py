"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.session import build_session

HEADLINE = ["features", "build_dataset", "dataset_summary", "build_observations", "asof_reference", "asof_join_bucketed", "asof_bitemporal", "event_features", "event_window_stats", "cohort_jump_rates",
            "weekly_candidates", "outcome_calendar_days", "signal_calibration", "cluster_bootstrap", "brier_skill", "reliability_bins", "correlation_matrix", "score_portfolios", "portfolio_returns",
            "ttm_as_of", "fcf_history", "holding_conviction", "research_league", "capture_snapshot", "capture_outcomes", "html_to_text", "guidance_extraction", "merger_terms", "daily_movers", "full_outer_diff"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.catalog.all import JOBS
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        print(name, file=sys.stderr, flush=True)
        JOBS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
