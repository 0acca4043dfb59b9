"""Group-bys: the sales aggregate and the plain totals.

``by`` is an optional list of leading keys (``["client_id"]`` to do all clients in
one job). Every measure is additive until ``finish``, so Spark combines it on the
map side and a key holding a third of all rows reaches the exchange as one row per
task.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesflow.functions import per, to_units, to_usd
from salesflow.operators.clean import clamped_days, valid_zips
from salesflow.operators.enrich import enrich_zip, local_flag
from salesflow.schemas import GROUP_KEYS, UNKNOWN_CATEGORY, UNKNOWN_GROUP
from salesflow.sources.lookups import Lookups

SUMS = ["_quantity", "_quantity_n", "_units", "_units_n", "_orders"]

BASE = ["_rows_in", "_invalid_in", "_imputed_in"]
"""Counters of rows before the joins: a lookup key that occurs twice must not count a row twice."""

MISSES = ["_zip_misses", "_sku_misses"]


def sales_sums(cleaned: DataFrame, lookups: Lookups, by: Sequence[str] = ()) -> DataFrame:
    """Additive measures per ``(*by, *GROUP_KEYS)``, from cleaned transactions.

    Rows meet each lookup once, by broadcast or, past its limit, by one shuffle of narrow rows that
    adaptive execution splits where a key is hot. They are not collapsed before: rows of
    a lookup that large hardly repeat their keys, so a collapse moves all of them once more.

    A group may span several categories and reports the smallest. A minimum of
    text would make Spark sort all rows instead of hashing them, so it is taken
    of numbers in category order, or, with very many categories, of rows that were summed per
    category. Both give the same sums, also when a lookup key repeats.
    """
    return _joined_sums(valid_zips(cleaned), lookups, by, Measures(SUMS, [], []))


def counted_sums(cleaned: DataFrame, lookups: Lookups, by: Sequence[str] = ()) -> DataFrame:
    """``sales_sums``, and what the quality counters are sums of, from the same pass.

    The counters are measures of the aggregation, so a task that is run again after a lost
    executor does not count twice. Rows without a usable ZIP code form groups of their own, without
    keys but ``by`` (``_valid`` false): one a client.
    """
    return _joined_sums(cleaned, lookups, by, Measures([*SUMS, *MISSES], BASE, ["_valid"]))


@dataclass(frozen=True)
class Measures:
    """What is summed: ``joined`` counts every joined row, ``base`` every row before the joins.
    ``keys`` are further grouping keys."""

    joined: list[str]
    base: list[str]
    keys: list[str]

    @property
    def counting(self) -> bool:
        return bool(self.base)


FLAGS = ["_zip_invalid_flag", "_maturity_imputed_flag"]


def _joined_sums(rows: DataFrame, lookups: Lookups, by: Sequence[str], of: Measures) -> DataFrame:
    flags = FLAGS if of.counting else []
    # measures are derived after the joins: what may be shuffled to them stays narrow
    rows = rows.select(*by, "transaction_date", "maturity_date", "sku_id", "zip_code", "quantity_sold", "revenue_usd", *flags)
    zips = lookups.zip_side(_numbered_rows(lookups.zip, "zip_code") if of.counting else None)
    # both sides hold complete codes only, and those are equal as numbers where they are as texts
    rows, zips = _by_number(rows), _by_number(zips)
    rows = rows.transform(enrich_zip, zips).transform(local_flag).transform(_weighed, "_zip", of)
    rows = rows.drop("zip_code", "city", "state", "is_us")
    sku = lookups.sku.withColumn("category", F.coalesce("category", F.lit(UNKNOWN_CATEGORY)))
    category = "category"
    if lookups.few_categories:
        numbers = F.broadcast(category_numbers(lookups.sku))
        sku, category = sku.join(numbers, "category").drop("category"), "_category"
    skus = lookups.sku_side(_numbered_rows(sku, "sku_id") if of.counting else sku)
    joined = rows.join(skus, "sku_id", "left").withColumns(
        {
            "_sku_lookup_miss_flag": F.col("sku_group").isNull().cast("long"),
            "sku_group": F.coalesce("sku_group", F.lit(UNKNOWN_GROUP)),
            "is_high_priority": F.coalesce("is_high_priority", F.lit(False)),
            category: F.coalesce(category, F.lit(0 if lookups.few_categories else UNKNOWN_CATEGORY)),
        }
    )
    joined = joined.transform(_weighed, "_sku", of)
    joined = joined.withColumns(_measures(of))
    keys = [*by, *GROUP_KEYS, *of.keys]
    if of.counting:
        joined = joined.withColumn("_valid", F.col("_zip_invalid_flag") == 0)
        joined = joined.withColumns({k: F.when(F.col("_valid"), F.col(k)) for k in GROUP_KEYS})
    if lookups.few_categories:
        return _summed(joined, keys, of, category).join(numbers, "_category", "left").drop("_category")
    per_category = _summed(joined, [*keys, "category"], of)
    return _summed(per_category, keys, of, category)


def _summed(rows: DataFrame, keys: list[str], of: Measures, smallest: str | None = None) -> DataFrame:
    least = [F.min(smallest).alias(smallest)] if smallest else []
    return rows.groupBy(*keys).agg(
        *least,
        F.max("is_high_priority").alias("is_high_priority"),
        *[F.sum(name).alias(name) for name in [*of.joined, *of.base]],
    )


def _measures(of: Measures) -> dict[str, Column]:
    """The measures of one joined row; a sum of no value stays null."""
    one = F.lit(1).cast("long")
    known = {
        "_quantity": F.col("quantity_sold"),
        "_quantity_n": F.col("quantity_sold").isNotNull().cast("long"),
        "_units": to_units(F.col("revenue_usd")),
        "_units_n": F.col("revenue_usd").isNotNull().cast("long"),
        "_orders": one,
    }
    if of.counting:
        weight = F.col("_zip_first") * F.col("_sku_first")
        known |= {
            "_rows_in": weight,
            "_invalid_in": F.col("_zip_invalid_flag") * weight,
            "_imputed_in": F.col("_maturity_imputed_flag") * weight,
            "_zip_misses": F.col("_zip_lookup_miss_flag"),
            "_sku_misses": F.col("_sku_lookup_miss_flag"),
        }
    return {name: known[name] for name in [*of.joined, *of.base]}


def _by_number(frame: DataFrame) -> DataFrame:
    return frame.withColumn("zip_code", F.col("zip_code").try_cast("int"))


def _numbered_rows(lookup: DataFrame, key: str) -> DataFrame:
    """The lookup with ``_first``: 1 in one row of each key, 0 in its repetitions."""
    others = [c for c in lookup.columns if c != key]
    place = F.row_number().over(W.partitionBy(key).orderBy(*others))
    return lookup.withColumn("_first", (place == 1).cast("long"))


def _weighed(rows: DataFrame, side: str, of: Measures) -> DataFrame:
    """After a join: 1 in one of the rows that a row before it became (``_zip_first``, ``_sku_first``).
    Without counters, the miss flag is not kept."""
    if not of.counting:
        return rows.drop(f"{side}_lookup_miss_flag")
    return rows.withColumn(f"{side}_first", F.coalesce("_first", F.lit(1).cast("long"))).drop("_first")


def category_numbers(sku: DataFrame) -> DataFrame:
    """``category`` and ``_category``, a number in category order; the sentinel for
    unmatched SKUs is 0. One task orders the distinct categories only."""
    sentinel = F.lit(UNKNOWN_CATEGORY)
    known = sku.select(F.explode(F.array(F.coalesce("category", sentinel), sentinel)).alias("category")).distinct()
    everything = W.partitionBy(F.lit(1))
    place = F.row_number().over(everything.orderBy("category"))
    before = F.count_if(F.col("category") < sentinel).over(everything)
    return known.select("category", (place - before - 1).cast("int").alias("_category"))


def finish(sums: DataFrame) -> DataFrame:
    """Turn additive measures into the reported totals and means.

    The rows of a group agree in both dates, so their mean days to maturity is that
    of the dates. ``_units`` stays, as the exact value that shares and ranks are
    taken from.
    """
    others = [c for c in sums.columns if c not in SUMS]
    return sums.select(
        *others,
        F.coalesce("_quantity", F.lit(0)).alias("total_quantity"),
        F.coalesce(to_usd(F.col("_units")), F.lit(0.0)).alias("total_revenue"),
        F.col("_orders").alias("order_count"),
        per(F.col("_quantity"), F.col("_quantity_n")).alias("avg_quantity_per_order"),
        per(to_usd(F.col("_units")), F.col("_units_n")).alias("avg_order_value"),
        clamped_days().cast("double").alias("days_to_maturity"),
        F.coalesce("_units", F.lit(0)).alias("_units"),
    )


def sales_aggregate(cleaned: DataFrame, lookups: Lookups, by: Sequence[str] = ()) -> DataFrame:
    """Keys, category, priority and six measures; ``_units`` is still attached."""
    return finish(sales_sums(cleaned, lookups, by))


def split_counted(sums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of stored ``counted_sums``: the sales aggregate, and the one-row quality record (zeros when
    there was no row)."""
    counters = [*MISSES, *BASE]
    sales = finish(sums.filter("_valid").drop("_valid", *counters))
    of_valid = {"rows_after_join": "_orders", "zip_lookup_miss": "_zip_misses", "sku_lookup_miss": "_sku_misses"}
    of_all = {"rows_input": "_rows_in", "invalid_zip_dropped": "_invalid_in", "maturity_imputed": "_imputed_in"}
    zero = F.lit(0).cast("long")
    return sales, sums.agg(
        *[F.coalesce(F.sum(c), zero).alias(n) for n, c in of_all.items()],
        *[F.coalesce(F.sum(F.when(F.col("_valid"), F.col(c))), zero).alias(n) for n, c in of_valid.items()],
    )


def daily_totals(txn: DataFrame) -> DataFrame:
    """Per day: quantity, revenue, mean revenue and the number of rows."""
    return txn.groupBy("transaction_date").agg(*_totals(), F.count(F.lit(1)).alias("order_count"))


def daily_totals_nonnull(txn: DataFrame) -> DataFrame:
    """As ``daily_totals``, but undated rows are left out and only rows with a
    revenue are counted."""
    dated = txn.filter(F.col("transaction_date").isNotNull())
    return dated.groupBy("transaction_date").agg(*_totals(), F.count("revenue_usd").alias("order_count"))


def sku_day_totals(txn: DataFrame) -> DataFrame:
    quantity, revenue, _ = _totals()
    return txn.groupBy("sku_id", "transaction_date").agg(quantity, revenue)


def sku_concentration(txn: DataFrame, top_share: float = 0.2) -> DataFrame:
    """Share of all transactions held by the most frequent ``top_share`` of SKUs.

    SKUs are not ranked one by one. They are counted per frequency first, and N
    transactions have fewer than sqrt(2N) different frequencies, so the one
    running sum that needs an order stays small at any size.
    """
    per_sku = txn.groupBy("sku_id").agg(F.count(F.lit(1)).alias("hits"))
    by_hits = per_sku.groupBy("hits").agg(F.count(F.lit(1)).alias("skus"))
    totals = W.partitionBy(F.lit(1))
    descending = totals.orderBy(F.desc("hits")).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = by_hits.select(
        "hits",
        "skus",
        (F.sum("skus").over(descending) - F.col("skus")).alias("before"),
        F.floor(F.sum("skus").over(totals) * F.lit(top_share)).alias("wanted"),
    )
    taken = F.least(F.col("skus"), F.greatest(F.lit(0), F.col("wanted") - F.col("before")))
    return placed.agg(
        F.sum("skus").alias("sku_count"),
        F.max("wanted").alias("top_sku_count"),
        F.sum(F.col("skus") * F.col("hits")).alias("total_weight"),
        F.sum(taken * F.col("hits")).alias("top_weight"),
    ).withColumn("top_share", per(F.col("top_weight"), F.col("total_weight")))


def _totals() -> list[Column]:
    units = F.sum(to_units(F.col("revenue_usd")))
    return [
        F.coalesce(F.sum("quantity_sold"), F.lit(0)).alias("total_quantity"),
        F.coalesce(to_usd(units), F.lit(0.0)).alias("total_revenue"),
        per(to_usd(units), F.count("revenue_usd")).alias("avg_revenue"),
    ]
