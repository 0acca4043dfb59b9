"""Revenue share and dense rank per day and locality.

Both read ``_units`` of the sales aggregate, so ties and shares are exact. Input
is already aggregated: one day and locality holds at most (maturity dates x SKU
groups) rows. ``wide`` serves lookups with so many groups that even this is too
much for one task; it gives the same numbers from ranges of the order (``_ranged``).
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesflow.functions import per
from salesflow.session import Scratch

BROADCAST_RANGES = 100_000
"""Most (day, range) rows sent to every executor; more are joined by shuffle, with the same ranks."""

RANGE_BITS = 33
"""The bits of ``monotonically_increasing_id`` below the number of the partition."""


def revenue_share(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    total = F.sum("_units").over(W.partitionBy(*_day(by)))
    return sales.withColumn("_day_units", total).transform(_share)


def revenue_rank(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    best_first = W.partitionBy(*_day(by)).orderBy(F.desc("_units"))
    return sales.withColumn("revenue_rank", F.dense_rank().over(best_first).cast("long"))


def share_and_rank(sales: DataFrame, by: Sequence[str] = (), wide: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Both columns, from one exchange (or by ranges when ``wide``, which stores ``sales`` once
    in ``scratch`` and reads it from there)."""
    if wide:
        return _ranged(sales, by, scratch or Scratch(sales.sparkSession))
    return sales.transform(revenue_share, by).transform(revenue_rank, by)


def _ranged(sales: DataFrame, by: Sequence[str], scratch: Scratch) -> DataFrame:
    """The different values of all days are put into one order by ranges, so that a day is spread
    over as many tasks as its values fill. A value's place in its range is a number of the stored
    row; what comes before the range in its day is counted from one row per day and range.

    Ranges are chosen by sampling, which may come out differently when it is done again. So
    the order is stored, and both uses read the same one.
    """
    day = _day(by)
    order = [*[F.col(c) for c in day], F.desc("_units")]
    stored = scratch(sales, "aggregate")
    values = stored.groupBy(*day, "_units").agg(F.count(F.lit(1)).alias("_rows"))
    ordered = values.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch(ordered.withColumn("_at", F.monotonically_increasing_id()), "values")
    placed = placed.withColumn("_range", F.shiftright("_at", RANGE_BITS))
    per_range = placed.groupBy(*day, "_range").agg(
        F.min("_at").alias("_first"),
        F.count(F.lit(1)).alias("_values"),
        F.sum(F.col("_units") * F.col("_rows")).alias("_range_units"),
    )
    of_day = W.partitionBy(*day)
    before = of_day.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = scratch(
        per_range.select(
            *day,
            "_range",
            (F.coalesce(F.sum("_values").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"),
            F.sum("_range_units").over(of_day).alias("_day_units"),
        ),
        "ranges",
    )
    if ranges.count() <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    ranks = _same_day(placed, ranges, [*day, "_range"]).select(
        *day, "_units", "_day_units", (F.col("_at") + F.col("_offset")).alias("revenue_rank")
    )
    return _same_day(stored, ranks, [*day, "_units"]).transform(_share)


def _share(sales: DataFrame) -> DataFrame:
    total = F.col("_day_units")
    share = F.when(total > 0, per(F.col("_units"), total)).otherwise(F.lit(0.0))
    return sales.withColumn("revenue_share_of_day", share).drop("_day_units")


def _day(by: Sequence[str]) -> list[str]:
    return [*by, "transaction_date", "local"]


def _same_day(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which an undated group matches itself, as in a window."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, match).drop(*[f"_r_{k}" for k in keys])
