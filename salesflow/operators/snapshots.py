"""Cumulative daily snapshots: day N holds every row of days 1..N."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesflow.functions import lenient_date
from salesflow.session import workspace

BROADCAST_MARKS = 100_000
"""Most clients' arrival days sent to every executor."""


def snapshot(txn: DataFrame, day: str) -> DataFrame:
    """The rows a snapshot of that day holds, out of a table of all rows."""
    return txn.filter(F.col("transaction_date") <= day)


def snapshot_rows(txn: DataFrame, by: Sequence[str] = ("client_id",)) -> DataFrame:
    """New and cumulative rows per snapshot, without building any snapshot."""
    daily = txn.groupBy(*by, "transaction_date").agg(F.count(F.lit(1)).alias("new_rows"))
    so_far = W.partitionBy(*by).orderBy("transaction_date").rowsBetween(W.unboundedPreceding, 0)
    return daily.select(
        *by,
        F.col("transaction_date").alias("snapshot_day"),
        "new_rows",
        F.sum("new_rows").over(so_far).alias("snapshot_rows"),
    )


def late_rows(arrived: DataFrame, by: Sequence[str] = ("client_id",)) -> DataFrame:
    """Rows a strict ``>`` high-water filter never processes.

    ``arrived`` has an ``arrival_day``. A row is late when an earlier snapshot
    already held a row of its own day or a later one. High-water dates come from
    one row per arrival day; those are stored and counted, and broadcast while
    they are few, so that no row is shuffled on its day.
    """
    # a maximum of dates is hashed; one of text would sort all rows
    newest = F.max(lenient_date(F.col("transaction_date")))
    seen = arrived.groupBy(*by, "arrival_day").agg(newest.cast("string").alias("_newest"))
    before = W.partitionBy(*by).orderBy("arrival_day").rowsBetween(W.unboundedPreceding, -1)
    marks = seen.select(*by, "arrival_day", F.max("_newest").over(before).alias("high_water"))
    spark, path = arrived.sparkSession, workspace(arrived.sparkSession, "salesflow-marks")
    marks.write.parquet(path)
    marks = spark.read.schema(marks.schema).parquet(path)
    if marks.count() <= BROADCAST_MARKS:
        marks = F.broadcast(marks)
    return arrived.join(marks, [*by, "arrival_day"]).filter(F.col("transaction_date") <= F.col("high_water"))
