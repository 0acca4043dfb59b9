"""Schemas, key lists and fixed values shared by every module."""

from pyspark.sql import types as T

# --- fixed values: names, formats and constants the results depend on -------
IMPUTE_DAYS = 3
ZIP_DIGITS = 5
LOCAL_STATE = "CA"
UNKNOWN_GROUP = "UNKNOWN"
UNKNOWN_CATEGORY = "Unassigned"
UNKNOWN_STATE = "UNKNOWN"
UNKNOWN_CITY = "Unknown"
TOP_ROWS = 5
PARITY_RTOL = 1e-6
PARITY_ATOL = 1e-6
DIFF_ATOL = 1e-4

TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("transaction_date", T.StringType()),
        T.StructField("sku_id", T.StringType()),
        T.StructField("quantity_sold", T.LongType()),
        T.StructField("revenue_usd", T.DoubleType()),
        T.StructField("maturity_date", T.StringType()),
        T.StructField("zip_code_raw", T.StringType()),
    ]
)

SKU_LOOKUP = T.StructType(
    [
        T.StructField("sku_id", T.StringType()),
        T.StructField("sku_group", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("is_high_priority", T.StringType()),
    ]
)

ZIP_LOOKUP = T.StructType(
    [
        T.StructField("zip_code", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("is_us", T.StringType()),
    ]
)

GROUP_KEYS = ["transaction_date", "maturity_date", "sku_group", "local"]

METRICS = [
    "total_quantity",
    "total_revenue",
    "order_count",
    "avg_quantity_per_order",
    "avg_order_value",
    "days_to_maturity",
    "revenue_share_of_day",
    "revenue_rank",
]

SALES_COLUMNS = GROUP_KEYS + ["category", "is_high_priority"] + METRICS

STATE = T.StructType(
    [
        T.StructField("client_id", T.StringType()),
        T.StructField("transaction_date", T.StringType()),
        T.StructField("maturity_date", T.StringType()),
        T.StructField("sku_group", T.StringType()),
        T.StructField("local", T.IntegerType()),
        T.StructField("total_quantity", T.LongType()),
        T.StructField("total_revenue", T.DoubleType()),
        T.StructField("order_count", T.LongType()),
        T.StructField("avg_quantity_per_order", T.DoubleType()),
        T.StructField("avg_order_value", T.DoubleType()),
        T.StructField("days_to_maturity", T.DoubleType()),
        T.StructField("revenue_share_of_day", T.DoubleType()),
        T.StructField("revenue_rank", T.LongType()),
    ]
)
# --- end of fixed values ----------------------------------------------------

STATE_KEYS = ["client_id"] + GROUP_KEYS
STATE_PARTITIONS = ["client_id", "transaction_date"]

LANDING = T.StructType([T.StructField("client_id", T.StringType())] + TRANSACTIONS.fields)
LANDING_PARTITIONS = ["client_id", "transaction_date"]
