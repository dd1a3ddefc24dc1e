"""Time the headline queries: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each
query is built and written to the ``noop`` sink; intermediate tables a query writes are in its time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from rillway.plans.catalogue import QUERIES
from rillway.session import build_session, drop_scratch

RUNS = 3
HEADLINE = [name for name in QUERIES if name.startswith("w_")] + [
    "q_wide_join",
    "q_group_stats",
    "q_window_group",
    "q_sort_numeric",
    "q_rule_clean",
    "q_token_blocks",
    "q_line_diff",
    "q_stream_counts",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(RUNS)), 3)
    drop_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "total of the median seconds per headline query",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
