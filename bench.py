"""Times the headline queries on the star-schema tables and prints one JSON line.

Every query does its own work from the tables to the last row, after one untimed run of a
small query that starts the engine. Nothing is kept from one query to the next.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from suite.queries import QUERIES

HEADLINE = (
    "scan_csv", "canonicalize", "quarterly_aggregates", "trend_features", "pipeline_risks",
    "flag_risks", "demo_risk", "top_spend_latest", "top_risers_latest", "watchlist",
    "risk_summary_ordered", "state_spend_trend", "universe_summary", "kpi_summary",
    "forecast_universe", "forecast_batch", "forecast_grouped_map", "history_with_forecast",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("claimtrends-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    timed("distinct_states")
    seconds = {name: timed(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline queries, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
