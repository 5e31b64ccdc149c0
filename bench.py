"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one line of JSON with the seconds of each.

The machine is told with them: its cores, the load on it when the bench began, and the milliseconds of a fixed loop
before and after, by which runs on different machines, or on a busy one, can be told apart.

Each query runs once to warm up, then as often as $BENCH_RUNS says (3), and its median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from millrace.queries import QUERIES

HEADLINES = [
    "script_end_to_end", "where_range", "select_arith", "select_if", "regex_match", "regex_replace_all", "group_count", "group_sum", "group_avg_int", "group_avg_double", "group_median", "group_max",
    "join_natural", "join_natural_dup", "join_left_defaults", "join_anti", "join_consistent_hash", "topk_idiom", "order_by_multi", "rownum", "prev_lag", "prev_running_sum", "unique_rows", "str_split", "time_extract", "json_get", "tsv_roundtrip",
]


def loop_ms() -> float:
    """The best of five runs of a fixed loop."""
    took = []
    for _ in range(5):
        began = time.perf_counter()
        sum(range(2_000_000))
        took.append((time.perf_counter() - began) * 1000)
    return round(min(took), 1)


def main() -> None:
    machine = {"cores": os.cpu_count(), "load": round(os.getloadavg()[0], 2), "loop_ms": [loop_ms()]}
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    with tempfile.TemporaryDirectory() as folder:
        conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g", "spark.checkpoint.dir": f"file://{folder}"}
        spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(map=conf).getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        seconds = {}
        for name in HEADLINES:
            took = []
            for _ in range(runs + 1):
                began = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - began)
            seconds[name] = round(statistics.median(took[1:]), 3)
        spark.stop()
    machine["loop_ms"].append(loop_ms())
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "runs": runs, "machine": machine}))


if __name__ == "__main__":
    main()
