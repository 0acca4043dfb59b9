"""The landing table: transactions once, as Parquet by client and day.

A cumulative snapshot repeats every earlier day. Landed by transaction date, a
snapshot replaces the days it holds, each row is stored once, and a later
incremental run reads only the days it needs: its filter is on partition columns.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.schemas import LANDING, LANDING_PARTITIONS

ROW_GROUP_BYTES = 8 * 1024 * 1024
"""Of a file's parts that are read by tasks of their own, before compression. A day's file of the default
size would be one such part, and a run over a few days is read by as many tasks."""


def land(txn: DataFrame, path: str) -> None:
    """Replace the client-days present in ``txn``; others stay as they are.

    The rebalance gives each day files of a sensible size: small days are put
    together and a hot day is split over several tasks.
    """
    rows = txn.select(*LANDING.fieldNames())
    replace_partitions(rows, path, LANDING_PARTITIONS)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDING).parquet(path).select(*LANDING.fieldNames())


def landed_days(spark: SparkSession, path: str) -> DataFrame:
    """client_id, transaction_date of every partition, from the names of its files; none is opened."""
    names = "path string, modificationTime timestamp, length long, content binary, client_id string, transaction_date string"
    listed = spark.read.format("binaryFile").schema(names).load(path)
    return listed.select(*LANDING_PARTITIONS).distinct()


def replace_partitions(rows: DataFrame, path: str, partitions: list[str]) -> None:
    (
        rows.hint("rebalance", *[F.col(p) for p in partitions])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .partitionBy(*partitions)
        .parquet(path)
    )
