"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then three times, or fewer once it has
taken ``BENCH_BUDGET`` seconds; the median of the warm runs counts. Every run
computes all rows and columns of its result.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskweave.plans.checks import build_queries  # noqa: E402
from riskweave.session import local_session  # noqa: E402

HEADLINE = [
    "normalize_all",
    "feat_volume_spike",
    "feat_dest",
    "feat_rate_mad_z",
    "feat_memo_entropy",
    "features_all",
    "features_ties",
    "features_hot_accounts",
    "feat_tx_count_ledgers",
    "topk_volume_spike",
    "temporal_split",
    "ts_folds",
    "stratified_split",
    "robust_scale",
    "ks_two_sample",
    "signals",
    "alerts",
    "score_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    budget = float(os.environ.get("BENCH_BUDGET", "30"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    partitions = int(cores) if cores.isdigit() else 8
    spark = local_session(cores, os.environ.get("BENCH_MEMORY", "8g"), partitions)
    all_queries = build_queries()
    seconds = {}
    for name in names:
        runs = []
        while len(runs) < repeats + 1 and (len(runs) < 2 or sum(runs) < budget):
            start = time.perf_counter()
            all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:] or runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
