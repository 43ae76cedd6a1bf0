"""Headline queries, timed; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; its time is the median, from building the
plan to the last row (written to Spark's noop sink). The full load runs anew every time; queries on
loaded tables use one load, made before the clock starts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import QUERIES, STAMP, loaded, new_store  # noqa: E402
from partgraph.plans.load import load_sheet  # noqa: E402
from partgraph.session import tune  # noqa: E402
from partgraph.sources.trade import change_sheet, part_sheet  # noqa: E402

HEADLINE = (
    "clean_text", "clean_sheet", "recipe_stats", "surrogate_key", "part_with_supplier", "dedup_first",
    "part_to_box", "part_to_model", "box_to_pallet", "breakpoint_seq", "before_change", "part_history",
    "part_overview", "find_by_part", "find_by_supplier", "find_by_model_code", "fk_orphans", "check_pk_unique",
    "table_counts", "null_profile", "correct_parts", "insert_new",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)

    def full_load() -> None:
        load_sheet(new_store(spark, "bench"), part_sheet(spark, folder), change_sheet(spark, folder), stamp=STAMP)

    def timed(run) -> float:
        run()
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        return round(statistics.median(times), 3)

    seconds = {"load_sheet": timed(full_load)}
    loaded(spark, folder)
    for name in HEADLINE:
        seconds[name] = timed(lambda n=name: QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save())
    result = {
        "metric": "sum of median query seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
