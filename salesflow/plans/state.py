"""The ``processed_sales`` table: Parquet by client and day.

A batch replaces exactly the client-days it holds, and empties those it was told to redo and has
no row for, in one write: an emptied day gets one row of nulls, which ``read_state`` leaves out.
Each run can be repeated: a second run, or a rerun after a lost executor or a failed job, writes
the same days with the same rows.

Beside the table lies a ledger of its client-days and their numbers of rows. It is
written after the days, so it never names a day that was not stored, and last stored days
are read from it without opening the table. Before the days are written a marker is
set, and it is removed after the ledger is. Where a run finds one, the run before ended between
both: the ledger is older than the table, so its marks make the run redo all days since,
and the days that the broken run may have stored are looked up in the table itself and redone as well.
"""

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesflow.plans.ledger import KEYS, Ledger
from salesflow.schemas import STATE, STATE_PARTITIONS
from salesflow.session import Scratch, folder
from salesflow.sources.landing import replace_partitions

NEVER_NULL = "sku_group"
"""Of stored rows; null in the row of an emptied day."""


def to_state(sales: DataFrame, client_id: str | None = None) -> DataFrame:
    """The thirteen stored columns: dates as text, ``local`` as 0/1."""
    owned = sales if client_id is None else sales.withColumn("client_id", F.lit(client_id))
    return owned.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in STATE.fields])


def state_path(spark: SparkSession, root: str) -> str:
    """The newest version of the table whose stored schema is the expected one.

    A table of another schema is left alone. The next version starts empty, so the
    next batch rebuilds it from the source.
    """
    version = 1
    while (stored := _stored_schema(spark, f"{root}/processed_sales_v{version}")) is not None:
        if _fits(stored):
            break
        version += 1
    return f"{root}/processed_sales_v{version}"


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows; no rows when nothing was stored yet."""
    try:
        stored = spark.read.schema(STATE).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], STATE)
    return stored.filter(F.col(NEVER_NULL).isNotNull()).select(*STATE.fieldNames())


def stored_days(spark: SparkSession, path: str) -> Ledger:
    """client_id, transaction_date, rows (0: emptied)."""
    return Ledger(spark, f"{path}_days", [("rows", T.LongType())])


def day_counts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The client-days of the table, now or after a batch. Opens no file of it, unless a table has no ledger yet."""
    days = stored_days(spark, path)
    if not days.exists() and _stored_schema(spark, path) is not None:
        return _counted(read_state(spark, path))
    return days.read(upto)


def marks(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """client_id, last_processed_date: the last stored day of each client that has one."""
    return high_water(day_counts(spark, path, upto).filter("rows > 0"))


def high_water(days: DataFrame) -> DataFrame:
    """The last day per client, of state rows or of client-days."""
    return days.groupBy("client_id").agg(_last_day())


def last_processed_date(state: DataFrame, client_id: str) -> DataFrame:
    """One row for one client, null when it has no stored day."""
    return state.filter(F.col("client_id") == client_id).agg(_last_day())


def _last_day():
    """As a date, because a maximum of text would be taken by sorting."""
    newest = F.max(F.col("transaction_date").cast("date"))
    return newest.cast("string").alias("last_processed_date")


def write_days(batch: DataFrame, path: str, redone: DataFrame | None = None) -> int:
    """Insert or replace the batch's client-days, and empty those of ``redone`` (client_id,
    transaction_date) that it has no row for. Returns the number of the ledger's entry.

    No column may be null; the check rides on the write, so there is no second
    pass. Keys are unique because the batch is grouped by them.
    """
    spark = batch.sparkSession
    checked = batch.select([_required(f.name, f.dataType).alias(f.name) for f in STATE.fields])
    checked = checked.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        entries, rows = _counted(checked), checked
        if redone is not None:
            empty = redone.select(*KEYS).distinct().join(entries, KEYS, "left_anti")
            nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in STATE.fields if f.name not in KEYS]
            # the row of nulls is of the table's layout, so one dynamic overwrite does both
            rows = checked.unionByName(empty.select(*KEYS, *nulls))
            entries = entries.unionByName(empty.withColumn("rows", F.lit(0).cast("long")))
        marker, system = folder(spark, f"{path}_days/_writing")
        system.mkdirs(marker)
        replace_partitions(rows, path, STATE_PARTITIONS)
        number = stored_days(spark, path).append(entries)
        system.delete(marker, True)
        return number
    finally:
        checked.unpersist()


def interrupted(spark: SparkSession, path: str) -> bool:
    """Whether a write ended before its ledger entry was made."""
    marker, system = folder(spark, f"{path}_days/_writing")
    return system.exists(marker)


def days_since(spark: SparkSession, path: str, since: DataFrame, inclusive: bool = True) -> DataFrame:
    """The stored client-days from (or after) ``last_processed_date`` on, for each row of ``since``
    (client_id, last_processed_date; null: all of them)."""
    days = day_counts(spark, path).filter("rows > 0").select(*KEYS)
    broken = interrupted(spark, path)
    if broken:
        days = days.unionByName(read_state(spark, path).select(*KEYS)).distinct()
    if broken or not stored_days(spark, path).exists():
        # read from the table itself, which the caller is about to change
        days = Scratch(spark)(days, "days")
    since = since.select(F.col("client_id"), F.col("last_processed_date").alias("_since"))
    day, mark = F.col("transaction_date"), F.col("_since")
    return days.join(since, "client_id").filter(mark.isNull() | (day >= mark if inclusive else day > mark)).select(*KEYS)


def rebuild_client(batch: DataFrame, path: str, client_id: str) -> None:
    """Drop every stored day of one client and store the batch instead."""
    spark = batch.sparkSession
    one = spark.createDataFrame([(client_id, None)], "client_id string, last_processed_date string")
    write_days(batch.filter(F.col("client_id") == client_id), path, days_since(spark, path, one))


def _counted(state):
    return state.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"))


def _required(name, kind):
    failure = F.raise_error(F.lit(f"null in stored column {name}")).cast(kind)
    return F.when(F.col(name).isNull(), failure).otherwise(F.col(name))


def _stored_schema(spark, path):
    try:
        return spark.read.parquet(path).schema
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _fits(stored):
    """Same data columns, types and order; partition types are read back by guess."""
    expected = [(f.name, f.dataType) for f in STATE.fields if f.name not in STATE_PARTITIONS]
    found = [(f.name, f.dataType) for f in stored.fields if f.name not in STATE_PARTITIONS]
    return found == expected and [f.name for f in stored.fields[-2:]] == STATE_PARTITIONS
