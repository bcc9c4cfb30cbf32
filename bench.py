"""Benchmark of the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]: one warm-up, then the median of $BENCH_REPS timed runs.
A run executes the full plan into Spark's ``noop`` sink (no driver collect).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "list_newest", "stats_global", "latest_version", "url_upsert", "targets_view",
    "job_links", "parse_cascade", "index_and_search", "search", "health_fold",
]


def bench_queries(registered: dict) -> dict:
    """The registered queries; ``search`` finds its index standing after the
    warm-up, ``index_and_search`` writes a new one each time."""
    from hirelake.operators import search as R
    from hirelake.plans import q_search as Q
    from hirelake.session import scratch_path

    def index_and_search(spark, sf_dir):
        path = scratch_path(spark, "index")
        R.write_index(Q._built(spark, sf_dir), path)
        return R.search_page(R.search_hits(spark.read.parquet(path), Q.Q_TEXT), 1, 20)

    return {**registered, "index_and_search": index_and_search}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from hirelake.plans.registry import QUERIES, load_all
    from hirelake.session import build_session

    load_all()
    spark = build_session(f"local[{cpus}]", int(cpus) * 2)
    timings, errors, found = {}, {}, bench_queries(QUERIES)
    for name in names:
        fn = found[name]
        runs = []
        try:
            for i in range(reps + 1):
                t0 = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                if i:
                    runs.append(dt)
            timings[name] = round(statistics.median(runs), 3)
        except Exception as e:  # keep measuring the others; report the failure
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total_median_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus), "reps": reps, "pyspark": __import__("pyspark").__version__,
        **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
