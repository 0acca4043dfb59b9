"""Incremental runs over cumulative snapshots.

A run reads each client's last stored day, filters the source by it, runs the full
pipeline on what is left and replaces the client-days of the result. All clients
of a run share one job. Modes:

``from``     redo the last stored day and everything after it (default). Equal to
             a full recompute as long as no row arrives for an earlier day.
``after``    only days after the last stored one; rows that arrive late are lost.
``changed``  redo every day whose rows differ from when it was last processed, of
             any age. Needs one aggregation over the whole snapshot.

Undated rows belong to no day. In every mode and every run they are left out, counted
in the result and logged.

Shares and ranks stay right because they are taken per day and a batch holds whole
days.
"""

import logging
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesflow.functions import to_units
from salesflow.operators.parity import parity_diff, parity_head, parity_summary
from salesflow.operators.snapshots import snapshot
from salesflow.plans.pipeline import sales
from salesflow.plans.ledger import KEYS, Ledger
from salesflow.plans.state import day_counts, days_since, marks, state_path, stored_days, to_state, write_days
from salesflow.schemas import STATE_KEYS, TRANSACTIONS
from salesflow.session import Scratch
from salesflow.sources.lookups import Lookups

log = logging.getLogger(__name__)

MODES = ("from", "after", "changed")

BROADCAST_DAYS = 100_000
"""Most client-days (or clients) sent to every executor; more are joined by shuffle, with the same rows."""

FINGERPRINT = [("rows", T.LongType()), ("units", T.LongType()), ("fingerprint", T.DecimalType(38, 0))]


@dataclass(frozen=True)
class BatchResult:
    """What a run did. The frames are small tables and read when asked for: ``before`` is the
    last stored day each client had, ``entries`` the written client-days with their rows."""

    path: str
    before: DataFrame
    entries: DataFrame | None = None
    undated: int = 0

    @cached_property
    def high_water(self) -> dict[str, str | None]:
        return {row["client_id"]: row["last_processed_date"] for row in self.before.collect()}

    @cached_property
    def days(self) -> list[tuple[str, str]]:
        return self._days("rows > 0")

    @cached_property
    def cleared(self) -> list[tuple[str, str]]:
        return self._days("rows = 0")

    def _days(self, which):
        return [] if self.entries is None else sorted(tuple(r) for r in self.entries.filter(which).select(*KEYS).collect())


Clients = Sequence[str] | DataFrame
"""Names, or a frame with a column ``client_id``."""


def run_batch(
    spark: SparkSession,
    txn: DataFrame,
    lookups: Lookups,
    root: str,
    clients: Clients,
    mode: str = "from",
    landed: DataFrame | None = None,
) -> BatchResult:
    """Process one snapshot (``client_id`` plus the transaction columns).

    ``landed``: the client-days of ``txn`` where it is a landing table (``landing.landed_days``); a
    run then opens the partitions of due days only.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode != "changed" and day_ledger(spark, root).exists():
        raise ValueError(f"{root} is kept in mode 'changed'; a run in another mode would outdate its ledger")
    return _run(spark, txn, lookups, root, state_path(spark, root), clients, mode, landed)


def replay(
    spark: SparkSession,
    txn: DataFrame,
    lookups: Lookups,
    root: str,
    clients: Clients,
    days: Iterable[str],
    mode: str = "from",
    landed: DataFrame | None = None,
) -> str:
    """Run the snapshots of ``days`` in order against the state in ``root``.

    Days depend on each other through the state, so this is a loop of jobs. To
    fill a new table from a long history use one full run instead.
    """
    path = None
    for day in days:
        seen, listed = snapshot(txn, day), None if landed is None else snapshot(landed, day)
        if path is None:
            path = run_batch(spark, seen, lookups, root, clients, mode, listed).path
        else:
            _run(spark, seen, lookups, root, path, clients, mode, listed)
    return path or state_path(spark, root)


def check_day(txn: DataFrame, lookups: Lookups, state: DataFrame, client_id: str, day: str) -> bool:
    """Recompute one stored client-day from the source and compare. A difference is
    logged with the first keys it affects and what each side holds there."""
    this = (F.col("client_id") == client_id) & (F.col("transaction_date") == day)
    stored = state.filter(this)
    again = sales(txn.filter(this), lookups, by=["client_id"]).transform(to_state)
    if parity_summary(stored, again, keys=STATE_KEYS).first()["parity_pass"]:
        return True
    for row in parity_head(parity_diff(stored, again, keys=STATE_KEYS), keys=STATE_KEYS).collect():
        log.warning("stored result differs from its recomputation: %s", row.asDict())
    return False


def check_days(txn: DataFrame, lookups: Lookups, state: DataFrame, most: int = 5) -> DataFrame:
    """The verdict of every stored client-day, all recomputed in one job. Logs how many differ,
    and the first of them."""
    days = state.select(*KEYS).distinct()
    again = sales(on_days(txn, days), lookups, by=["client_id"]).transform(to_state)
    verdicts = Scratch(txn.sparkSession)(parity_summary(state, again, by=KEYS, keys=STATE_KEYS), "verdicts")
    wrong = verdicts.filter("not parity_pass")
    if number := wrong.count():
        first = [tuple(r) for r in wrong.orderBy(*KEYS).limit(most).select(*KEYS).collect()]
        log.warning("%d stored days differ from their recomputation, the first are %s", number, first)
    return verdicts


def due_days(landed: DataFrame, since: DataFrame, inclusive: bool) -> DataFrame:
    """The landed client-days to process, for clients and their last stored days."""
    day, mark = F.col("transaction_date"), F.col("last_processed_date")
    later = day >= mark if inclusive else day > mark
    return landed.join(since, "client_id").filter(day.isNotNull() & (mark.isNull() | later)).select(*KEYS)


def due_rows(txn: DataFrame, since: DataFrame, inclusive: bool, few: bool) -> DataFrame:
    """The same for the rows of any frame, whose client-days are not known."""
    marked = since.select(F.col("client_id").alias("_client"), F.col("last_processed_date").alias("_mark"))
    day, mark = F.col("transaction_date"), F.col("_mark")
    due = (F.col("client_id") == F.col("_client")) & (mark.isNull() | (day >= mark if inclusive else day > mark))
    return txn.join(F.broadcast(marked) if few else marked, due, "left_semi")


def day_ledger(spark: SparkSession, root: str) -> Ledger:
    """The fingerprint of each client-day when it was last processed in mode ``changed``."""
    return Ledger(spark, f"{root}/day_ledger", FINGERPRINT)


def day_fingerprints(txn: DataFrame) -> DataFrame:
    """Rows, revenue and an order-free checksum of all columns per client-day."""
    checksum = F.xxhash64(*TRANSACTIONS.fieldNames()).cast("decimal(20,0)")
    return txn.groupBy("client_id", "transaction_date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(to_units(F.col("revenue_usd"))).alias("units"),
        F.sum(checksum).cast("decimal(38,0)").alias("fingerprint"),
    )


def changed_days(current: DataFrame, known: DataFrame) -> DataFrame:
    """Client-days that are new, gone or different; a gone day has zero rows."""
    keys = ["client_id", "transaction_date"]
    values = ["rows", "units", "fingerprint"]
    before = known.withColumnsRenamed({c: f"_known_{c}" for c in keys + values})
    match = [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys]
    same = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"_known_{v}")) for v in values])
    return current.join(before, match, "full").filter(~same).select(
        *[F.coalesce(k, f"_known_{k}").alias(k) for k in keys],
        F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
        "units",
        "fingerprint",
    )


def _run(spark, txn, lookups, root, path, clients, mode, landed):
    names = clients if isinstance(clients, DataFrame) else spark.createDataFrame([(c,) for c in clients], "client_id string")
    names = names.select("client_id").distinct()
    since = names.join(marks(spark, path), "client_id", "left").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        few = since.count() <= BROADCAST_DAYS
        own = names.select(F.col("client_id").alias("_client"))
        own = txn.join(F.broadcast(own) if few else own, F.col("client_id") == F.col("_client"), "left_semi")
        undated = own.filter(F.col("transaction_date").isNull()).count()
        if undated:
            log.warning("%d undated rows are left out", undated)
        dated = txn.filter(F.col("transaction_date").isNotNull())
        if mode == "changed":
            own = own.filter(F.col("transaction_date").isNotNull())
            return _run_changed(spark, own, lookups, root, path, names, undated)
        # a mark is the newest stored day, so it is the only stored day that is redone,
        # unless the run before was broken off
        inclusive = mode == "from"
        redone = days_since(spark, path, since, inclusive)
        if landed is None:
            return _replace(spark, due_rows(dated, since, inclusive, few), lookups, path, redone, names, undated)
        due = due_days(landed, since, inclusive).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return _replace(spark, on_days(dated, due), lookups, path, redone, names, undated)
        finally:
            due.unpersist()
    finally:
        since.unpersist()


def _run_changed(spark, txn, lookups, root, path, names, undated):
    ledger = day_ledger(spark, root)
    known = ledger.read().join(names, "client_id", "left_semi")
    changed = changed_days(day_fingerprints(txn), known).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if changed.isEmpty():
            return BatchResult(path, _before(spark, path, names, stored_days(spark, path).last()), undated=undated)
        redone = day_counts(spark, path).filter("rows > 0").join(changed.select(*KEYS), KEYS, "left_semi")
        result = _replace(spark, on_days(txn, changed), lookups, path, redone, names, undated)
        ledger.append(changed)
        return result
    finally:
        changed.unpersist()


def on_days(frame: DataFrame, days: DataFrame, most: int = BROADCAST_DAYS) -> DataFrame:
    """The rows of ``frame`` on the given client-days, none of them null. Up to ``most`` of
    them are broadcast, so rows are not shuffled and partitions of other days are not opened."""
    number, first = days.agg(F.count(F.lit(1)), F.min("transaction_date")).first()
    if first is not None:
        # known when the partitions are listed, also where they are not pruned by the join
        frame = frame.filter(F.col("transaction_date") >= first)
    # Spark prunes partitions by joins on plain equality, and by a side that has a filter
    wanted = days.select(*[F.col(k).alias(f"_on_{k}") for k in KEYS]).filter(F.col("_on_transaction_date") > "")
    match = [F.col(k) == F.col(f"_on_{k}") for k in KEYS]
    return frame.join(F.broadcast(wanted) if number <= most else wanted, match, "left_semi")


def _replace(spark, source, lookups, path, redone, names, undated):
    """Write the batch; empty those redone days for which it holds nothing."""
    batch = sales(source, lookups, by=["client_id"]).transform(to_state)
    number = write_days(batch, path, redone)
    return BatchResult(path, _before(spark, path, names, number - 1), stored_days(spark, path).of_batch(number), undated)


def _before(spark, path, names, upto):
    """The marks as they were after an earlier batch."""
    return names.join(marks(spark, path, upto), "client_id", "left")
