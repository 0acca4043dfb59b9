"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. The queries are run in
turn, a few times in a warm session, and medians are reported; a run builds the plan,
executes it whole and throws the rows away. With ``BENCH_ROWS`` set, the same is done on that
many generated rows landed as Parquet, the size the published numbers are for.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from salesflow.operators import aggregate, clean, synth
from salesflow.plans import catalog, incremental, pipeline
from salesflow.session import local_session, workspace
from salesflow.sources import driver_tables as model
from salesflow.sources.landing import land, landed_days, read_landing
from salesflow.sources.tables import read_transactions

HEADLINE = ["full_pipeline", "incremental_batch", "daily_totals", "date_filter_gt", "quality_report", "multi_client_pipeline"]
WARM_UPS = 2
REPEATS = 3


def consume(frame):
    """A build that writes its result itself returns nothing."""
    if frame is None:
        return
    frame.write.format("noop").mode("overwrite").save()


def timed(builds):
    """Median seconds per query. All queries take turns, so that each is timed in
    an equally warm session."""
    seconds = {name: [] for name in builds}
    for _ in range(WARM_UPS + REPEATS):
        for name, build in builds.items():
            start = time.perf_counter()
            consume(build())
            seconds[name].append(time.perf_counter() - start)
    return {name: round(statistics.median(runs[WARM_UPS:]), 3) for name, runs in seconds.items()}


def headline(spark, sf_dir):
    """``incremental_landed`` is one run over the tenth day by high water; landing the rows and
    storing nine days before it is not timed. Each further run redoes that day."""
    queries = catalog.queries()
    root, landed, lookups = catalog.landed_state(spark, sf_dir, "2025-10-09")

    def one_day():
        incremental.run_batch(spark, landed, lookups, root, model.CLIENTS, landed=landed_days(spark, f"{root}/landing"))

    builds = {name: lambda q=queries[name]: q(spark, sf_dir) for name in HEADLINE}
    return timed(builds | {"incremental_landed": one_day})


def at_scale(spark, sf_dir, rows):
    """A ten-day snapshot of ``rows`` generated transactions: a large first day and
    2,000 rows on each later one, full against incremental."""
    root = workspace(spark, "salesflow-bench")
    lookups = model.lookups(spark, sf_dir)
    made = synth.transactions(spark.range(rows), lookups, rows - 9 * 2_000, 2_000, bits=15)
    made.write.option("header", True).csv(f"{root}/csv")
    from_csv = read_transactions(spark, f"{root}/csv")
    land(from_csv.withColumn("client_id", F.lit("client_1")), f"{root}/landing")
    landed = read_landing(spark, f"{root}/landing")
    due = F.col("transaction_date") >= "2025-10-09"
    return timed(
        {
            "full_pipeline_csv": lambda: pipeline.sales(from_csv, lookups),
            "full_pipeline_landed": lambda: pipeline.sales(landed, lookups),
            "incremental_landed": lambda: pipeline.sales(landed.filter(due), lookups),
            "daily_totals_csv": lambda: aggregate.daily_totals(from_csv),
            "date_filter_csv": lambda: clean.after_date(from_csv, "2025-10-05"),
        }
    )


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "salesflow-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = headline(spark, sf_dir)
    result = {
        "metric": "total_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if rows := int(os.environ.get("BENCH_ROWS", "0")):
        result["scale_rows"] = rows
        result["scale"] = at_scale(spark, sf_dir, rows)
    spark.stop()
    print(json.dumps(result))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
