"""Zipped daily snapshots as a Spark data source, to read and to write.

``spark.read.format("sales_archive")`` yields one input partition per archive. The
first member of each archive is parsed as a typed CSV and streamed in Arrow
batches, so a task holds one block of text whatever the archive's size. Deflate
cannot be split, so a file is the unit of parallelism. A large snapshot is therefore written as
several files, ``transactions_day_<day>.part-<number>-of-<all>.zip``, each an archive like the one
of a small snapshot; it is read only when all of them are there.

Options: ``root``, and ``clients`` and ``days`` (comma-separated) to name archives, of which each has to
exist. Without either, the archives under ``root`` are found by their names. Filters
on client and snapshot day decide which archives are opened. Paths may be local
or any URI that Arrow's file systems open. On a cluster ship this package to the
executors, for example with ``--py-files``.

Writing takes rows sorted by client and day (``write_archives``): a task streams one archive after
the other under temporary names, which the driver replaces when all tasks are done, so a task
that is run again or a job that fails leaves no part of an archive behind.
"""

import operator
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesflow.schemas import TRANSACTIONS
from salesflow.session import ship

BLOCK_BYTES = 8 * 1024 * 1024

ARCHIVE = T.StructType(
    [T.StructField("client_id", T.StringType()), T.StructField("snapshot_day", T.IntegerType())]
    + TRANSACTIONS.fields
)


def archive_path(root: str, client_id: str, day: int) -> str:
    """Where the cumulative snapshot of one client and day lies."""
    return f"{root.rstrip('/')}/{client_id}/transactions_day_{day}.zip"


NAME = re.compile(r"(?:^|/)([^/]+)/transactions_day_([0-9]+)(?:\.part-([0-9]+)-of-([0-9]+))?\.zip$")
"""Client and day in the path of an archive, and number and count of its parts if it has several."""


def part_path(path: str, part: int, parts: int) -> str:
    """Where one of several files of an archive lies; the path itself where there is one."""
    return path if parts == 1 else f"{path.removesuffix('.zip')}.part-{part:05d}-of-{parts:05d}.zip"

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def read_archives(spark: SparkSession, root: str, clients: list[str] | None = None, days: list[int] | None = None) -> DataFrame:
    """The archives of some clients and days, or (with neither) all that there are."""
    _register(spark)
    reader = spark.read.format(ArchiveSource.name()).option("root", root)
    for option, values in (("clients", clients), ("days", days)):
        if values is not None:
            reader = reader.option(option, ",".join(map(str, values)))
    # Spark keeps the reader of a frame's last filtered scan for scans without a filter, so none may be without
    return reader.load().filter(F.col("snapshot_day").isNotNull())


def write_archives(snapshots: DataFrame, root: str) -> None:
    """One archive per client and ``snapshot_day``, in several files where it is large.

    The rebalance gives a task rows of about the advisory partition size: those of a large snapshot are
    split over several tasks, so what one of them sorts does not grow with the snapshot.
    """
    _register(snapshots.sparkSession)
    keys = ["client_id", "snapshot_day"]
    rows = snapshots.select([snapshots[f.name].cast(f.dataType).alias(f.name) for f in ARCHIVE.fields])
    rows = rows.hint("rebalance", *[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    rows.write.format(ArchiveSource.name()).option("root", root).mode("append").save()


def _register(spark):
    ship(spark)
    # a source that takes filters fails to plan where this is off
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ArchiveSource)


class ArchiveSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sales_archive"

    def schema(self) -> T.StructType:
        return ARCHIVE

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> ds.DataSourceWriter:
        return ArchiveWriter(self.options["root"])


@dataclass
class Archive(ds.InputPartition):
    client_id: str
    day: int
    path: str


class ArchiveReader(ds.DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.clients = options["clients"].split(",") if "clients" in options else None
        self.days = [int(d) for d in options["days"].split(",")] if "days" in options else None
        self.wanted = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Takes every comparison with the client or the day: an archive has one of each."""
        tests = {
            ds.EqualTo: operator.eq,
            ds.EqualNullSafe: operator.eq,
            ds.GreaterThan: operator.gt,
            ds.GreaterThanOrEqual: operator.ge,
            ds.LessThan: operator.lt,
            ds.LessThanOrEqual: operator.le,
            ds.In: lambda own, values: own in values,
            ds.IsNotNull: lambda own, _: own is not None,
        }
        places = {("client_id",): 0, ("snapshot_day",): 1}
        for one in filters:
            if type(one) in tests and one.attribute in places:
                self.wanted.append((places[one.attribute], tests[type(one)], getattr(one, "value", None)))
            else:
                yield one

    def partitions(self) -> list[Archive]:
        named = self._named() if self.clients and self.days else self._found()
        return [a for a in named if all(test((a.client_id, a.day)[place], value) for place, test, value in self.wanted)]

    def _named(self):
        found = {}
        for client in dict.fromkeys(self.clients):
            for one in self._found(f"/{client}"):
                found.setdefault((one.client_id, one.day), []).append(one)
        for wanted in ((c, d) for c in self.clients for d in self.days):
            # opening one that is not there fails
            yield from found.get(wanted) or [Archive(*wanted, archive_path(self.root, *wanted))]

    def _found(self, below=""):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root)
        found = {}
        for info in system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}{below}", recursive=True, allow_not_found=bool(below))):
            name = NAME.search(info.path)
            if name and name[1] in (self.clients or [name[1]]) and int(name[2]) in (self.days or [int(name[2])]):
                part, parts = int(name[3] or 0), int(name[4] or 1)
                found.setdefault((name[1], int(name[2])), set()).add((part, parts))
        for (client, day), files in found.items():
            whole, count = archive_path(self.root, client, day), len(files)
            if files != {(n, count) for n in range(count)}:
                raise ValueError(f"{whole} lacks parts, or has those of two writes: {sorted(files)}")
            yield from (Archive(client, day, part_path(whole, n, count)) for n in range(count))

    def read(self, partition: Archive | None) -> Iterator:
        if partition is None:  # no archive is wanted
            return
        import pyarrow as pa
        from pyarrow import csv, fs

        types = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
        columns = {f.name: types[f.dataType.simpleString()] for f in TRANSACTIONS.fields}
        target = pa.schema([("client_id", pa.string()), ("snapshot_day", pa.int32()), *columns.items()])
        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            with archive.open(archive.namelist()[0]) as member:
                batches = csv.open_csv(
                    member,
                    read_options=csv.ReadOptions(block_size=BLOCK_BYTES, use_threads=False),
                    convert_options=csv.ConvertOptions(
                        column_types=columns,
                        include_columns=list(columns),
                        null_values=[""],
                        strings_can_be_null=True,
                    ),
                )
                for batch in batches:
                    client = pa.array([partition.client_id] * batch.num_rows, pa.string())
                    day = pa.array([partition.day] * batch.num_rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([client, day, *batch.columns], schema=target)


@dataclass
class Written(ds.WriterCommitMessage):
    """What a task wrote: temporary paths, each with that of the archive it is (a part of)."""

    paths: list[tuple[str, str]]


class ArchiveWriter(ds.DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator) -> Written:
        import pyarrow.compute as pc
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root)
        done, current, stream = [], None, None
        for batch in iterator:
            at = 0
            while at < len(batch):
                key = batch.column("client_id")[at].as_py(), batch.column("snapshot_day")[at].as_py()
                if None in key:
                    raise ValueError("a row without client or snapshot day belongs to no archive")
                # rows are sorted, so those of one archive are neighbours
                rest = batch.slice(at)
                same = pc.and_(pc.equal(rest.column("client_id"), key[0]), pc.equal(rest.column("snapshot_day"), key[1]))
                size = pc.sum(same).as_py()
                if key != current:
                    if stream:
                        stream.close()
                    final = archive_path(base, *key)
                    temporary = f"{final}.{uuid.uuid4().hex}"
                    done.append((temporary, final))
                    stream, current = _Stream(system, temporary), key
                stream.write(rest.slice(0, size).select(TRANSACTIONS.fieldNames()))
                at += size
        if stream:
            stream.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root)
        written = {}
        for temporary, final in _paths(messages):
            written.setdefault(final, []).append(temporary)
        earlier = {}
        for folder in {final.rsplit("/", 1)[0] for final in written}:
            for info in system.get_file_info(fs.FileSelector(folder)):
                if name := NAME.search(info.path):
                    earlier.setdefault((folder, int(name[2])), []).append(info.path)
        for final, files in written.items():
            placed = [part_path(final, n, len(files)) for n in range(len(files))]
            for temporary, path in zip(files, placed):
                system.move(temporary, path)
            folder, day = final.rsplit("/", 1)[0], int(NAME.search(final)[2])
            for path in earlier.get((folder, day), []):
                if path.rsplit("/", 1)[1] not in {p.rsplit("/", 1)[1] for p in placed}:
                    system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root)
        for temporary, _ in _paths(messages):
            system.delete_file(temporary)


def _paths(messages):
    return [paths for message in messages if message for paths in message.paths]


class _Stream:
    """One archive that is being written, block by block."""

    def __init__(self, system, path):
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.file = system.open_output_stream(path)
        self.archive = zipfile.ZipFile(self.file, "w", zipfile.ZIP_DEFLATED)
        self.member = self.archive.open("transactions.csv", "w", force_zip64=True)
        self.writer = None

    def write(self, rows):
        from pyarrow import csv

        self.writer = self.writer or csv.CSVWriter(self.member, rows.schema)
        self.writer.write(rows)

    def close(self):
        for part in (self.writer, self.member, self.archive, self.file):
            part.close()
