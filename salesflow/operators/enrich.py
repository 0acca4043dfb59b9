"""Lookup joins, sentinel values and the local flag.

Left joins keep every transaction. A lookup key that occurs twice yields two
rows. Miss flags and fills of one lookup sit in one projection, because a miss is
judged on the value before it is filled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesflow.schemas import (
    LOCAL_STATE,
    UNKNOWN_CATEGORY,
    UNKNOWN_CITY,
    UNKNOWN_GROUP,
    UNKNOWN_STATE,
)


def enrich_sku(frame: DataFrame, sku: DataFrame) -> DataFrame:
    return frame.join(sku, "sku_id", "left").withColumns(
        {
            "_sku_lookup_miss_flag": F.col("sku_group").isNull().cast("long"),
            "sku_group": _filled("sku_group", UNKNOWN_GROUP),
            "category": _filled("category", UNKNOWN_CATEGORY),
            "is_high_priority": _filled("is_high_priority", False),
        }
    )


def enrich_zip(frame: DataFrame, zips: DataFrame) -> DataFrame:
    return frame.join(zips, "zip_code", "left").withColumns(
        {
            "_zip_lookup_miss_flag": F.col("state").isNull().cast("long"),
            "state": _filled("state", UNKNOWN_STATE),
            "city": _filled("city", UNKNOWN_CITY),
            "is_us": _filled("is_us", False),
        }
    )


def local_flag(frame: DataFrame) -> DataFrame:
    """True for rows in the home state. Comes after ``enrich_zip``, so never null."""
    return frame.withColumn("local", F.col("is_us") & (F.col("state") == LOCAL_STATE))


def _filled(name: str, value) -> Column:
    return F.coalesce(F.col(name), F.lit(value))
