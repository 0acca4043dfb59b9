"""The transaction model laid over the given tables.

Every rule is integer arithmetic on keys, so that Spark and the oracle SQL build
the same rows. One line item is one transaction; ``part`` and ``customer`` act as
the SKU and ZIP lookups. No row of any table is left out: lookup misses come from
lookup rows whose key carries a prefix no transaction uses.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.schemas import LANDING, TRANSACTIONS
from salesflow.sources.lookups import Lookups
from salesflow.sources.tables import parse_sku_lookup, parse_zip_lookup

# --- fixed values: the model's calendar and shapes --------------------------
START_DATE = "2025-10-01"
LAST_DATE = "2025-10-10"
FILTER_DATE = "2025-10-05"
NUM_DAYS = 10
CLIENTS = ["client_1", "client_2"]
MALFORMED_DATE = "2025-13-01"
COLUMNS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT",
    "part": "p_partkey BIGINT, p_brand STRING, p_type STRING, p_size INT",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
}
# --- end of fixed values ----------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The columns in use. A given schema saves the job that would read footers."""
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str, malformed: bool = False, after: str | None = None) -> DataFrame:
    """``client_id`` and the seven transaction columns; only days past ``after``, if given.

    Both sides of this join grow with the data, so neither is ever broadcast. A
    sort-merge join spills, and adaptive execution splits an order key that
    holds too many lines.
    """
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "concat('client_', cast(1 + o_custkey % 2 as string)) AS client_id",
        f"{_NOISY_ZIP} AS zip_code_raw",
    )
    lines = table(spark, sf_dir, "lineitem")
    if after is not None:
        # the day follows from the order key, so both sides are cut down before the join
        orders = orders.filter(f"date_add(DATE '{START_DATE}', cast(o_orderkey % 10 as int)) > DATE '{after}'")
        lines = lines.filter(f"{_DAY} > DATE '{after}'")
    lines = lines.join(orders.hint("merge"), F.expr("l_orderkey = o_orderkey"))
    columns = _line_columns(malformed)
    return lines.selectExpr(*[f"{columns.get(n, n)} AS {n}" for n in LANDING.fieldNames()])


def lines_only(spark: SparkSession, sf_dir: str, malformed: bool = False, after: str | None = None) -> DataFrame:
    """The transaction columns that need no join: all but client and ZIP text. Only days past
    ``after``, if given: compared as dates, before any is written out."""
    columns = _line_columns(malformed)
    names = [n for n in TRANSACTIONS.fieldNames() if n in columns]
    lines = table(spark, sf_dir, "lineitem")
    if after is not None:
        lines = lines.filter(f"{_DAY} > DATE '{after}'")
    return lines.selectExpr(*[f"{columns[n]} AS {n}" for n in names])


def sku_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").selectExpr(
        f"concat(if(p_partkey % 40 = 7, 'RETIRED_', 'SKU_'), {_padded('p_partkey', 5)}) AS sku_id",
        "p_brand AS sku_group",
        "p_type AS category",
        "if(p_size > 25, 'TRUE', 'false') AS is_high_priority",
    )
    return parse_sku_lookup(raw)


def zip_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    raw = (
        table(spark, sf_dir, "customer")
        .join(nation, F.expr("c_nationkey = n_nationkey"))
        .selectExpr(
            f"concat(if(c_custkey % 30 = 7, 'CLOSED_', ''), {_padded('c_custkey', 5)}) AS zip_code",
            "c_mktsegment AS city",
            "if(n_regionkey = 1, 'CA', n_name) AS state",
            "if(c_custkey % 5 <> 0, 'True', 'FALSE') AS is_us",
        )
    )
    return parse_zip_lookup(raw)


def lookups(spark: SparkSession, sf_dir: str) -> Lookups:
    """Measured once per application and folder; the given tables do not change."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _measured:
        _measured[known] = Lookups.measured(sku_lookup(spark, sf_dir), zip_lookup(spark, sf_dir))
    return _measured[known]


_measured: dict[tuple[str, str], Lookups] = {}


def arrivals(txn: DataFrame) -> DataFrame:
    """Transactions with the day on which each first appears in a snapshot.

    Most rows arrive on their own day; some arrive one day later.
    """
    number = F.substring("transaction_id", 5, 20).cast("long")
    order = F.floor(number / 10)
    own_day = F.col("transaction_date")
    late = (order % 97 == 0) & (own_day < LAST_DATE)
    next_day = F.date_add(own_day.cast("date"), 1).cast("string")
    return txn.withColumn("arrival_day", F.when(late, next_day).otherwise(own_day))


def perturbed(sales: DataFrame) -> DataFrame:
    """A copy that differs on purpose: the negative control of the parity check."""
    leader = (F.col("revenue_rank") == 1) & ~F.col("local")
    gone = (F.col("sku_group") == "Brand#2") & F.col("local")
    return sales.filter(~gone).withColumn(
        "total_revenue",
        F.when(leader, F.col("total_revenue") + 1).otherwise(F.col("total_revenue")),
    )


def _padded(number: str, width: int) -> str:
    """Zero-padded digits; a longer number keeps all of its digits."""
    digits = f"cast({number} as string)"
    return f"lpad({digits}, greatest(length({digits}), {width}), '0')"


_DAY = f"date_add(DATE '{START_DATE}', cast(l_orderkey % 10 as int))"

_CODE = _padded("o_custkey", 5)

_NOISY_ZIP = f"""CASE
    WHEN o_orderkey % 100 < 20 THEN concat({_CODE}, '-0042')
    WHEN o_orderkey % 100 < 35 THEN concat(' ', {_CODE}, '  ')
    WHEN o_orderkey % 100 < 45 THEN concat(substring({_CODE}, 1, 3), ' ', substring({_CODE}, 4))
    WHEN o_orderkey % 100 < 52 THEN concat('ZIP', {_CODE})
    WHEN o_orderkey % 100 < 58 THEN concat('zip', {_CODE})
    WHEN o_orderkey % 100 < 63 THEN 'INTL 00000'
    WHEN o_orderkey % 100 < 67 THEN 'INVALID_ZIP'
    WHEN o_orderkey % 100 < 70 THEN NULL
    ELSE {_CODE} END"""


def _line_columns(malformed: bool) -> dict[str, str]:
    bad = f"WHEN (l_orderkey + l_linenumber) % 25 = 1 THEN '{MALFORMED_DATE}'" if malformed else ""
    offset = "cast((l_orderkey * 7 + l_linenumber) % 49 - 4 as int)"
    return {
        "transaction_id": f"concat('TXN_', {_padded('l_orderkey * 10 + l_linenumber', 10)})",
        "transaction_date": f"cast({_DAY} as string)",
        "sku_id": f"concat('SKU_', {_padded('l_partkey', 5)})",
        "quantity_sold": "cast(l_quantity as bigint)",
        "revenue_usd": "l_extendedprice",
        "maturity_date": f"""CASE WHEN (l_orderkey + l_linenumber) % 25 = 0 THEN NULL {bad}
            ELSE cast(date_add({_DAY}, {offset}) as string) END""",
    }
