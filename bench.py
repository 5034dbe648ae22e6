"""Times every registered query; prints one JSON line.

BENCH_SF_DIR: folder of test tables. BENCH_CPUS: local cores. Every query runs to a sink that
discards rows, once to warm up and then BENCH_RUNS (2) times; its time is the median. `load` is the
one-off derivation of the domain tables and is not part of the total.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from backhaul.adapter import open_tables
from backhaul.checks.queries import registered
from backhaul.schemas import TABLES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
RUNS = int(os.environ.get("BENCH_RUNS", 2))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    tables = open_tables(spark, SF_DIR)
    load = timed(lambda: [tables.table(name) for name in TABLES])
    seconds = {}
    for name, query in registered().items():

        def run():
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()

        run()
        seconds[name] = round(statistics.median(timed(run) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "cpus": CPUS,
                "load": round(load, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
