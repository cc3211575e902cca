"""Times the headline queries on $BENCH_SF_DIR and prints one JSON line.

Every query runs once to warm the session, then three times; the median counts. Results are
fully computed (written to Spark's no-op sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tideguard.plans.catalog import QUERIES  # noqa: E402
from tideguard.session import local_session  # noqa: E402

HEADLINE = [
    "kw_match",
    "kw_verdict",
    "content_keys",
    "reuse_exact",
    "reuse_two_tier",
    "hash_known",
    "reuse_semantic",
    "gateway",
    "text_funnel",
    "decide",
    "batch_dedup",
    "moderate_batch",
    "feedback_run",
    "kw_discovery",
    "eval_confusion",
    "eval_latency",
    "train_classifier",
    "stream_dedup",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def seconds(name: str, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=8)
    times = {}
    for name in HEADLINE:
        seconds(name, spark, sf_dir)
        times[name] = round(statistics.median(seconds(name, spark, sf_dir) for _ in range(RUNS)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "documents": documents,
                "documents_per_second": {
                    n: round(documents / times[n])
                    for n in ("kw_match", "kw_verdict", "gateway", "moderate_batch", "reuse_exact")
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
