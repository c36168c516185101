"""Bench: every registered query on one scale factor, timed end to end.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (optional comma list).  Each query is planned and fully
executed into Spark's ``noop`` sink (no driver collect), one after another
in one session, after a warm-up run.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlens import catalog  # noqa: E402
from cohortlens.session import local_session  # noqa: E402

HEADLINE = "feature_matrix"


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), memory="8g")
    names = only or list(catalog.QUERIES)
    # warm-up: JVM, code generation, file listing
    run(catalog.QUERIES[HEADLINE](spark, sf_dir))
    times = {}
    for name in names:
        t0 = time.perf_counter()
        run(catalog.QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_seconds_all_queries", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "headline": {HEADLINE: times.get(HEADLINE)},
           "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
