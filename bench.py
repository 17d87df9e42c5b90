"""Headline queries, timed: one JSON line, seconds per query (median of warm runs).

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores. Results go to a sink that drops
the rows but computes all of them. Queries that land pages and build tables run fewer times.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pricewell.session import build_session  # noqa: E402
from pricewell.workload.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
JOBS = (
    "full_load", "partial_load", "stream_ingest", "stream_sessions", "increment_load", "malformed_ids", "stored_postcode_report",
    "stored_station_history", "report_after_increments", "series_append", "stream_out_of_order", "stream_overlap", "parked_expiry",
)
WARM_UP = 1


def run(spark, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    spark = build_session(
        "pricewell-bench", f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in QUERIES:
        warm, runs = (0, 1) if name in JOBS else (WARM_UP, RUNS)
        for _ in range(warm):
            run(spark, name)
        times[name] = round(statistics.median(run(spark, name) for _ in range(runs)), 4)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
        "sf": Path(SF_DIR).name.removeprefix("sf"), "cpus": int(CPUS), "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
