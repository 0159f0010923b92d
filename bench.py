"""Benchmark the headline queries.

Runs each query of HEADLINE on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line: total seconds and seconds per query.
Each query runs twice into the ``noop`` sink, which computes every column of every row;
the second run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "w5_sessionize",
    "h6_class_adjacency",
    "h8_sample_adjacency_v1",
    "r3_recommend",
    "r13_report",
    "k12_k16_k17_k20_wavelets",
    "k20_sample_wavelets",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    from tessera.plans.catalog import QUERIES
    from tessera.session import get_spark
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    # warm-up: JVM, codegen caches and file listing, not counted
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in names:
        for _ in range(2):  # the second run counts: code is compiled, files are listed
            t0 = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
