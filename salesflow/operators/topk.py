"""Top slices, leaderboards and the locality summary, all over the aggregate."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesflow.functions import per, to_units, to_usd
from salesflow.operators.clean import on_date
from salesflow.schemas import TOP_ROWS

TIE_BREAK = ["sku_group", "local", "maturity_date"]


def max_date(sales: DataFrame) -> DataFrame:
    """The latest day of the aggregate, one row, null when it is empty."""
    return sales.agg(F.max("transaction_date").cast("string").alias("target_transaction_date"))


def top_latest_day(sales: DataFrame, k: int = TOP_ROWS) -> DataFrame:
    """The ``k`` highest-revenue rows of the latest day.

    Ordering by day first means the k best rows overall are those of the latest
    day, topped up from earlier days if it has fewer; the filter on those k rows
    removes the top-up. No second pass finds the latest day.
    """
    best = sales.orderBy(F.desc("transaction_date"), F.desc("total_revenue"), *TIE_BREAK).limit(k)
    latest = F.max("transaction_date").over(W.partitionBy(F.lit(1)))
    return best.withColumn("_latest", latest).filter("transaction_date = _latest").drop("_latest")


def top_report(top: DataFrame) -> DataFrame:
    """The slice in report order with its display values."""
    return top.select(
        "sku_group",
        "maturity_date",
        F.when(F.col("local"), "Local").otherwise("Non-local").alias("locality"),
        "revenue_rank",
        "total_revenue",
        "order_count",
        "avg_order_value",
        "avg_quantity_per_order",
        (F.col("revenue_share_of_day") * 100).alias("revenue_share_percent"),
        "days_to_maturity",
    ).orderBy("revenue_rank", F.desc("total_revenue"), "sku_group", "locality", "maturity_date")


def leaderboard(sales: DataFrame, k: int = TOP_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Per day the ``k`` SKU groups (by locality) with the highest revenue.

    One pass serves every day: Spark keeps k rows per day and task before the
    exchange, so a hot day is cut down where it is read.
    """
    day = [*by, "transaction_date"]
    rolled = sales.groupBy(*day, "sku_group", "local").agg(
        F.sum(to_units(F.col("total_revenue"))).alias("_units"),
        F.sum("order_count").alias("order_count"),
    )
    total = F.sum("_units").over(W.partitionBy(*day, "local"))
    best_first = W.partitionBy(*day).orderBy(F.desc("_units"), "sku_group", "local")
    return (
        rolled.withColumn("_total", total)
        .withColumn("place", F.row_number().over(best_first).cast("long"))
        .filter(F.col("place") <= k)
        .select(
            *day,
            "place",
            "sku_group",
            "local",
            to_usd(F.col("_units")).alias("total_revenue"),
            "order_count",
            per(to_usd(F.col("_units")), F.col("order_count")).alias("avg_order_value"),
            F.coalesce(per(F.col("_units"), F.col("_total")), F.lit(0.0)).alias("revenue_share_of_day"),
        )
    )


def locality_summary(sales: DataFrame, day: str) -> DataFrame:
    """Local against non-local on one day, means weighted by orders."""
    orders = F.col("order_count")
    summed = (
        sales.transform(on_date, day)
        .groupBy("local")
        .agg(
            F.sum("total_quantity").alias("total_quantity"),
            to_usd(F.sum(to_units(F.col("total_revenue")))).alias("total_revenue"),
            F.sum("order_count").alias("order_count"),
            F.sum(F.col("avg_order_value") * orders).alias("_value"),
            F.sum(F.col("days_to_maturity") * orders).alias("_days"),
        )
    )
    return summed.select(
        F.when(F.col("local"), "Local (CA)").otherwise("Non-local").alias("segment"),
        "local",
        "total_quantity",
        "total_revenue",
        "order_count",
        F.when(orders > 0, F.col("_value") / orders).otherwise(0.0).alias("avg_order_value"),
        F.when(orders > 0, F.col("_days") / orders).otherwise(0.0).alias("avg_days_to_maturity"),
    ).orderBy(F.desc("local"))
