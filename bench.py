"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is materialised in full (noop sink) after one warm-up of the session; the best of two runs counts.
"""

import json
import os
import time

from groveflow.plans import QUERIES
from groveflow.session import local_session

HEADLINE = [
    "v01_grpo",
    "v13_gae",
    "v22_tree_summary",
    "a01_pass_at_n_summary",
    "a03_best_worst_at_n",
    "a10_weight_metrics",
    "j02_preference_pairs",
    "j03_pair_distances",
    "j10_inner_product_top_k",
    "j11_bm25_top_k",
    "j19_ranking_accuracy",
    "b01_allocation",
    "w13_replay_sample",
    "w16_logical_batches",
    "a18_sibling_bleu",
    "g01_grade_by_source",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), os.environ.get("BENCH_MEMORY", "12g"))
    spark.read.parquet(f"{path}/orders.parquet").groupBy("o_custkey").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(path.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
