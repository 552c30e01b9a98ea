"""Times the registered queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and cores, BENCH_QUERIES (comma separated)
a subset, BENCH_RUNS the runs of which the fastest counts.  ``build_series`` is the time to
derive and store the customer series, ``build_index`` to cut, store and sample them; both
come first, in a cold session, and the queries on them do not include it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.compare import session
from checks.queries import all_queries, spend, spend_index, vector_index


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = chosen.split(",") if chosen else list(queries)
    queries = {name: queries[name] for name in names}

    seconds = {}
    for name, build in (("build_series", spend), ("build_index", spend_index)):
        start = time.perf_counter()
        build(spark, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    vector_index(spark, sf_dir)
    for name, query in queries.items():
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(min(taken), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
