"""Benchmark: headline queries on the driver tables, one JSON line out.

    BENCH_SF_DIR   table directory (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_RUNS     timed runs per query after one warm-up (default 3)
    BENCH_QUERIES  comma-separated subset (default: the headline set)

Each query is forced with the ``noop`` sink (full execution, no result
transfer); the reported value per query is the median of the timed runs and
``value`` is their sum.  Building some DataFrames runs Spark jobs (the log
loader lists and sniffs files, model selection collects its statistics);
that time is included.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["prepare", "session_summary", "travel_direction", "segment_summary",
            "laser_per_second", "densify", "load_logs", "p_lin", "p_supsmu",
            "mixed_stats", "lmm_select"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from telespark.plans.registry import QUERIES
    from telespark.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                      app_name="telespark-bench")

    def run(name: str) -> float:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    times = {}
    for name in names:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
