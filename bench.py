"""Headline queries at one scale factor; prints a single JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).  Every
query is run once to warm the JVM and then timed into the noop sink, so all
rows are produced but nothing is written.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from verdikt.plans.catalog import QUERIES
from verdikt.session import build_session

HEADLINE = (
    "rank_uniform",
    "method_metrics",
    "whitened_rank",
    "strong_vs_weak",
    "override_cascade",
    "calibration_rates",
    "ablation",
    "tiebreak_cascade",
    "pair_consensus",
    "best_of_n_items",
    "dedupe_first_seen",
    "merge_proposals",
    "rule_compression",
    "bank_judgment",
    "redundancy_greedy",
    "refinement_worklist",
    "tfidf_topk",
    "cosine_topk",
    "expert_recall",
    "balanced_folds",
    "selection_audit",
    "quantile_report",
)


def timed(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", cpus, os.environ.get("BENCH_MEMORY", "8g"))
    seconds = {}
    for name in names:
        timed(spark, folder, name)
        seconds[name] = round(statistics.median(timed(spark, folder, name) for _ in range(runs)), 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else folder,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
