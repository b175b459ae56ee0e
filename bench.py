"""Seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from graftwork.plans.catalog import QUERIES
from graftwork.session import local_session

HEADLINE = (
    "T1_select_topk",
    "T1_select_topk_wide",
    "W3_rank_models_wide",
    "A1_token_accuracy_big",
    "A5_evaluate_big",
    "U5_pivot_results",
    "A7_with_avg_wide",
    "W2_training_to_parity_wide",
    "A14_timing",
    "P1_arc_easy",
    "M1_average_params",
    "M3_ties_merge",
    "M4_dare_ties_merge",
)
REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "graftwork-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        # The first run pays for compiling and for starting Python workers.
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
