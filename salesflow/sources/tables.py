"""Typed scans. Every schema is explicit, so no file is read twice to infer one."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesflow.schemas import SKU_LOOKUP, TRANSACTIONS, ZIP_LOOKUP


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transactions from CSV with a header; a value of the wrong type fails the run."""
    return _csv(spark, path, TRANSACTIONS)


def read_sku_lookup(spark: SparkSession, path: str) -> DataFrame:
    return parse_sku_lookup(_csv(spark, path, SKU_LOOKUP))


def read_zip_lookup(spark: SparkSession, path: str) -> DataFrame:
    return parse_zip_lookup(_csv(spark, path, ZIP_LOOKUP))


def parse_sku_lookup(raw: DataFrame) -> DataFrame:
    return _flag(raw, "is_high_priority")


def parse_zip_lookup(raw: DataFrame) -> DataFrame:
    return _flag(raw, "is_us")


def _csv(spark, path, schema):
    """Columns by name, in any order; others are ignored and a missing one fails.

    Spark applies a schema by position, so the known types are put into the order of the
    header first (one line of one file is read). Files whose header differs from that fail
    instead of being read wrongly.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    known = {f.name: f for f in schema}
    found = T.StructType([known.get(name, T.StructField(name, T.StringType())) for name in header])
    options = {"header": True, "mode": "FAILFAST", "enforceSchema": False}
    return spark.read.schema(found).options(**options).csv(path).select(*schema.fieldNames())


def _flag(raw, name):
    """``true`` in any case is true, other text is false, null stays null."""
    return raw.withColumn(name, F.lower(name) == "true")
