"""Session defaults and the place where intermediate tables may be written.

Cleanup rule: who starts a run drops its scratch folder once the results are written
(``Scratch.drop``, or ``with``); what crashed applications leave behind is dropped by ``sweep``,
which spares the folders of the calling application and whatever was written to lately.
"""

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", app: str = "salesflow") -> SparkSession:
    """A session for tests and benchmarks. A cluster brings its own settings."""
    partitions = "8" if cpus == "*" else cpus
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", home)


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder for one run's tables.

    It lies in the shared folder named by ``spark.checkpoint.dir``. Only a
    single-machine session without that setting uses its warehouse folder.
    """
    return f"{_shared(spark)}/{label}-{uuid.uuid4().hex}"


def _shared(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return shared.rstrip("/")


SCRATCH = "salesflow-scratch"


class Scratch:
    """Tables that one run writes and reads again. A table is computed when it is stored, once;
    everything that reads it later starts from there, also after a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{_shared(spark)}/{SCRATCH}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        self._stored = 0

    def __call__(self, frame: DataFrame, name: str) -> DataFrame:
        self._stored += 1
        path = f"{self.root}/{self._stored:02d}-{name}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self) -> None:
        """Frames read from it cannot be computed any more."""
        place, system = folder(self.spark, self.root)
        system.delete(place, True)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def sweep(spark: SparkSession, hours: float = 72) -> list[str]:
    """Drop the scratch folders of other applications that were not written to for so long."""
    place, system = folder(spark, _shared(spark))
    if not system.exists(place):
        return []
    now, own, gone = spark._jvm.System.currentTimeMillis(), spark.sparkContext.applicationId, []
    for status in system.listStatus(place):
        name = status.getPath().getName()
        if name.startswith(f"{SCRATCH}-") and not name.startswith(f"{SCRATCH}-{own}-"):
            if now - status.getModificationTime() >= hours * 3_600_000 and system.delete(status.getPath(), True):
                gone.append(name)
    return sorted(gone)


def folder(spark: SparkSession, path: str):
    """A path and its file system, as the driver's Hadoop client sees them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())
