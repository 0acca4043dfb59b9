"""Small tables of what is known per client-day, one batch of entries at a time.

Each append is a folder ``entries-<batch>``; the newest entry of a client-day counts. After
``COMPACT`` appends the newest entries are written together as ``all-<batch>``, and what lies before the
snapshot before it is dropped, so a reader opens a bounded number of folders and one that
has just listed them still finds them. A folder counts once its ``_SUCCESS`` is there:
a write that did not end is as if it had not begun, and is written again under the same number.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesflow.session import folder

COMPACT = 16
"""Appends between two snapshots."""

KEYS = ["client_id", "transaction_date"]


class Ledger:
    """Entries of ``values`` (name, type) per client-day under ``path``. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, values: list[tuple[str, T.DataType]]):
        self.spark, self.path = spark, path
        self.values = [name for name, _ in values]
        fields = [*((k, T.StringType()) for k in KEYS), *values, ("batch", T.LongType())]
        self.schema = T.StructType([T.StructField(name, kind) for name, kind in fields])

    def exists(self) -> bool:
        return bool(self._folders())

    def last(self) -> int:
        """The number of the last append, 0 before the first."""
        return max((number for _, number in self._folders()), default=0)

    def read(self, upto: int | None = None) -> DataFrame:
        """The newest entry of each client-day, of all appends or of those up to one; no rows
        before the first."""
        found = self._folders()
        return self._newest(self._current([f for f in found if upto is None or f[1] <= upto]))

    def of_batch(self, batch: int) -> DataFrame:
        """What one append held, until two snapshots later."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/entries-{batch:08d}").drop("batch")

    def append(self, entries: DataFrame) -> int:
        """Add entries (keys and values) and return the number of the batch."""
        found = self._folders()
        batch = max((number for _, number in found), default=0) + 1
        self._write(entries.withColumn("batch", F.lit(batch).cast("long")), f"entries-{batch:08d}")
        found.append(("entries", batch))
        snapshots = [n for kind, n in found if kind == "all"]
        if batch - max(snapshots, default=0) >= COMPACT:
            self._write(self._newest(self._current(found)).withColumn("batch", F.lit(batch).cast("long")), f"all-{batch:08d}")
            self._forget(found, max(snapshots, default=0))
        return batch

    def _write(self, frame, name):
        frame.select(self.schema.names).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def _folders(self) -> list[tuple[str, int]]:
        place, system = folder(self.spark, self.path)
        if not system.exists(place):
            return []
        names = [s.getPath().getName() for s in system.listStatus(place)]
        matches = filter(None, (re.fullmatch(r"(entries|all)-(\d+)", name) for name in names))
        done = [m for m in matches if system.exists(folder(self.spark, f"{self.path}/{m[0]}/_SUCCESS")[0])]
        return [(m[1], int(m[2])) for m in done]

    def _current(self, found):
        """The last snapshot and the entries after it."""
        last = max((n for kind, n in found if kind == "all"), default=0)
        return [f"{kind}-{n:08d}" for kind, n in found if n == last and kind == "all" or n > last]

    def _newest(self, names):
        if not names:
            return self.spark.createDataFrame([], self.schema).drop("batch")
        entries = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{name}" for name in names])
        newest = F.max_by(F.struct(*self.values), "batch").alias("_newest")
        return entries.groupBy(*KEYS).agg(newest).select(*KEYS, "_newest.*")

    def _forget(self, found, before):
        for kind, n in found:
            if n < before or (n == before and kind == "entries"):
                place, system = folder(self.spark, f"{self.path}/{kind}-{n:08d}")
                system.delete(place, True)
