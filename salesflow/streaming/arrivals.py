"""Process daily archives as they arrive.

A file stream lists new archives (names only; their content is not read here). For
each micro-batch the archives are landed and one incremental run brings the state
up to date. The stream's checkpoint remembers which archives are done. Both steps
can be repeated, so a batch that is retried after a failure changes nothing.
"""

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from salesflow.plans.incremental import run_batch
from salesflow.sources.archive import read_archives
from salesflow.sources.landing import land, landed_days, read_landing
from salesflow.sources.lookups import Lookups

log = logging.getLogger(__name__)

LANDED = "client_id string, day int"
MARKS = "_snapshots"

NAME_PATTERN = r"/([^/]+)/transactions_day_(\d+)(?:\.part-\d+-of-\d+)?\.zip$"

FILE_NAMES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def newest_archives(names: DataFrame) -> DataFrame:
    """Client and highest day among archive paths. Snapshots are cumulative, so the
    newest one of a client covers the others."""
    return (
        names.select(
            F.regexp_extract("path", NAME_PATTERN, 1).alias("client_id"),
            F.regexp_extract("path", NAME_PATTERN, 2).alias("day"),
        )
        .filter(F.col("client_id") != "")
        .groupBy("client_id")
        .agg(F.max(F.col("day").cast("int")).alias("day"))
    )


def process_arrivals(
    spark: SparkSession,
    archives: str,
    landing: str,
    root: str,
    lookups: Lookups,
    checkpoint: str,
    mode: str = "from",
    archives_per_batch: int = 100,
) -> StreamingQuery:
    """Take in every archive that is there now, then stop."""

    def handle(names: DataFrame, _batch_id: int) -> None:
        # at most archives_per_batch rows
        newest = [(r["client_id"], r["day"]) for r in newest_archives(names).collect()]
        if newest:
            ingest(spark, archives, landing, root, lookups, newest, mode)

    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_NAMES)
        .option("pathGlobFilter", "transactions_day_*.zip")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", archives_per_batch)
        .load(archives)
        .select("path")
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def landed_days(spark: SparkSession, landing: str) -> dict[str, int]:
    """The newest landed snapshot of each client, kept beside the landing table."""
    try:
        marks = spark.read.schema(LANDED).parquet(f"{landing}{MARKS}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return dict(marks.groupBy("client_id").agg(F.max("day")).collect())


def ingest(
    spark: SparkSession,
    archives: str,
    landing: str,
    root: str,
    lookups: Lookups,
    newest: Sequence[tuple[str, int]],
    mode: str = "from",
) -> None:
    """Land the given archives and bring their clients' state up to date.

    A snapshot older than the newest one landed of its client is ignored, whatever batch it
    comes in: it would put older days over newer ones.
    """
    known = landed_days(spark, landing)
    newer = [(client, day) for client, day in newest if day >= known.get(client, day)]
    for client, day in set(newest) - set(newer):
        log.warning("archive of day %d of %s is older than what is landed: ignored", day, client)
    by_day: dict[int, list[str]] = {}
    for client, day in newer:
        by_day.setdefault(day, []).append(client)
    for day, clients in by_day.items():
        land(read_archives(spark, archives, clients, [day]), landing)
    if not newer:
        return
    marks = spark.createDataFrame(newer, LANDED)
    marks.coalesce(1).write.mode("append").parquet(f"{landing}{MARKS}")
    clients = sorted({client for client, _ in newer})
    run_batch(spark, read_landing(spark, landing), lookups, root, clients, mode, landed_days(spark, landing))
