"""Headline queries over the whole tables, each timed three times, the median told; heavier ones once. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from tidepanel.plans.catalog import QUERIES
from tidepanel.session import local_session

HEADLINE = [
    "bucket_last", "merge_sources", "active_ffill", "panel_stats", "supervised_rows_active", "family_state", "future_targets",
    "asof_backward", "asof_backward_by", "stress_grid", "pairwise_correlation", "pairwise_jaccard", "score_predictions",
    "calibration_deciles", "result_slices", "bootstrap_cluster", "classify_domain_family", "normalize_markets",
]
# Told beside the headline's total, not in it.
HEAVY = ["rolling_corr_graph", "threshold_graph_features", "logistic_forecast", "market_components"]
RUNS = 3


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores))
    spark.range(1).count()
    times = {name: median(timed(spark, name, sf_dir) for _ in range(RUNS)) for name in HEADLINE}
    heavy = {name: timed(spark, name, sf_dir) for name in HEAVY}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "heavy": heavy,
                      "runs": RUNS, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
