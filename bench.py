"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and $BENCH_RUNS times (default 1) for the clock.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from gradeloom.plans import catalog
from gradeloom.session import local_session

HEADLINES = [
    "bm25_topk", "bm25_postings", "bm25_ndcg", "signature_lexical", "signature_recall", "qrels_parse",
    "typed_examples_parse", "label_report", "budget_report",
    "calibrated_pool", "scale_report_pooled", "order_noise", "block_design", "additive_fit",
    "frontier", "expected_regret", "cascade_summary", "pareto_front",
    "system_comparison", "slice_report", "comparison_grid", "temperature_grid_fit", "ece_by_bucket_raw",
    "conformal_fit", "rolling_coverage", "lambda_ranknet", "typed_losses", "verdict_parse", "training_slates",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, name="bench")
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        took = []
        for _ in range(runs + 1):  # the first run warms up the code paths of the query
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
