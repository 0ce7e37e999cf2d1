"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully materialised through the `noop` sink (no collect to the driver) and
timed once after a warm-up query. Prints one JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Set BENCH_QUERIES=a,b,c to run a subset. Shuffle partitions default to the core count
(AQE coalesces further); at sf0.1 that measured ~15% faster than twice the core count.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("MEMLAKE_MASTER", f"local[{cpus}]")

    from memlake.plans import load_all
    from memlake.session import get_spark

    queries, _ = load_all()
    spark = get_spark(master=f"local[{cpus}]", app="memlake-bench", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or sorted(queries)

    # warm-up (not timed): JVM code generation and the Arrow kernels' Python workers, on the
    # smallest data set when present (so no result of the timed runs is reused)
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for w in ("stats_total", "local_embed_dense", "search_with_fallback", "ingest_documents"):
        queries[w](spark, warm_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in wanted:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
