"""Data-quality counters and constraint checks, each a one-row frame."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.sources.lookups import Lookups


def quality_base(cleaned: DataFrame) -> DataFrame:
    """Counters taken before rows without a usable ZIP are dropped."""
    return cleaned.agg(
        F.count(F.lit(1)).alias("rows_input"),
        _total("_zip_invalid_flag").alias("invalid_zip_dropped"),
        _total("_maturity_imputed_flag").alias("maturity_imputed"),
    )


def quality_join(enriched: DataFrame) -> DataFrame:
    """Counters taken after both lookup joins."""
    return enriched.agg(
        F.count(F.lit(1)).alias("rows_after_join"),
        _total("_zip_lookup_miss_flag").alias("zip_lookup_miss"),
        _total("_sku_lookup_miss_flag").alias("sku_lookup_miss"),
    )


def quality_report(cleaned: DataFrame, lookups: Lookups) -> DataFrame:
    """All six counters from one pass over the transactions.

    Each lookup is reduced to how many rows a key has and how many of those count
    as a miss. Keys are then unique, the joins cannot multiply rows, and the join
    counters are products. Invalid rows have no ZIP code and weigh nothing. When
    a lookup is too large to broadcast, the rows are first collapsed to one per
    SKU and ZIP code, which also collapses hot and missing keys.
    """
    rows = F.lit(1).cast("long")
    counted = cleaned.select(
        "sku_id",
        "zip_code",
        rows.alias("_rows"),
        F.col("_zip_invalid_flag").cast("long").alias("_invalid"),
        F.col("_maturity_imputed_flag").cast("long").alias("_imputed"),
    )
    if not (lookups.sku_small and lookups.zip_small):
        counted = counted.groupBy("sku_id", "zip_code").agg(
            *[F.sum(c).alias(c) for c in ("_rows", "_invalid", "_imputed")]
        )
    skus = _fan_out(lookups.sku, "sku_id", "sku_group", "_sku")
    zips = _fan_out(lookups.zip, "zip_code", "state", "_zip")
    joined = counted.join(lookups.sku_side(skus), "sku_id", "left").join(
        lookups.zip_side(zips), "zip_code", "left"
    )
    valid = F.col("_rows") - F.col("_invalid")
    sku_rows, sku_misses = _or_one("_sku_rows"), _or_one("_sku_misses")
    zip_rows, zip_misses = _or_one("_zip_rows"), _or_one("_zip_misses")
    return joined.agg(
        _total("_rows").alias("rows_input"),
        _total("_invalid").alias("invalid_zip_dropped"),
        _total("_imputed").alias("maturity_imputed"),
        _total(valid * sku_rows * zip_rows).alias("rows_after_join"),
        _total(valid * sku_rows * zip_misses).alias("zip_lookup_miss"),
        _total(valid * sku_misses * zip_rows).alias("sku_lookup_miss"),
    )


def constraint_check(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicate keys, surplus rows and nulls per column; all zero when sound."""
    nulls = {c: F.sum(F.col(c).isNull().cast("long")) for c in state.columns}
    per_key = state.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[total.alias(f"null_{c}") for c, total in nulls.items()],
    )
    return per_key.agg(
        _total("_rows").alias("row_count"),
        _total((F.col("_rows") > 1).cast("long")).alias("duplicate_keys"),
        _total(F.col("_rows") - 1).alias("surplus_rows"),
        *[_total(f"null_{c}").alias(f"null_{c}") for c in state.columns],
    )


def _fan_out(lookup, key, judged, prefix):
    return lookup.groupBy(key).agg(
        F.count(F.lit(1)).alias(f"{prefix}_rows"),
        F.sum(F.col(judged).isNull().cast("long")).alias(f"{prefix}_misses"),
    )


def _or_one(name):
    """A key without a lookup row still yields one joined row, and that is a miss."""
    return F.coalesce(F.col(name), F.lit(1).cast("long"))


def _total(column):
    return F.coalesce(F.sum(column).cast("long"), F.lit(0).cast("long"))
