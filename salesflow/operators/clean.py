"""Row-level cleaning of raw transactions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesflow.functions import lenient_date, strict_date, zip_candidate
from salesflow.schemas import IMPUTE_DAYS, ZIP_DIGITS


def after_date(txn: DataFrame, last: str | None) -> DataFrame:
    """Rows dated strictly after ``last``; everything when there is no such date.

    The comparison is on the source text, before parsing, so it reaches the scan.
    """
    return txn if last is None else txn.filter(F.col("transaction_date") > last)


def from_date(txn: DataFrame, last: str | None) -> DataFrame:
    """As ``after_date`` but with the boundary day included."""
    return txn if last is None else txn.filter(F.col("transaction_date") >= last)


def on_date(frame: DataFrame, day: str) -> DataFrame:
    kind = frame.schema["transaction_date"].dataType
    return frame.filter(F.col("transaction_date") == F.lit(day).cast(kind))


def parse_dates(txn: DataFrame) -> DataFrame:
    parsed = txn.withColumns(
        {
            "_transaction_parsed": lenient_date(F.col("transaction_date")),
            "maturity_parsed": lenient_date(F.col("maturity_date")),
        }
    )
    checked = strict_date(F.col("transaction_date"), F.col("_transaction_parsed"))
    return parsed.withColumn("transaction_date", checked).drop("_transaction_parsed")


def normalize_zip(txn: DataFrame) -> DataFrame:
    candidate = zip_candidate(F.col("zip_code_raw"))
    complete = F.length("zip_candidate") == ZIP_DIGITS
    return txn.withColumn("zip_candidate", candidate).withColumns(
        {
            "zip_code": F.when(complete, F.col("zip_candidate")),
            "_zip_invalid_flag": F.when(complete, 0).otherwise(1),
        }
    )


def impute_maturity(txn: DataFrame, days: int = IMPUTE_DAYS) -> DataFrame:
    """Fill a missing or unreadable maturity date from the transaction date."""
    parsed = F.col("maturity_parsed")
    return txn.withColumns(
        {
            "maturity_date": F.coalesce(parsed, F.date_add("transaction_date", days)),
            "_maturity_imputed_flag": F.when(parsed.isNull(), 1).otherwise(0),
        }
    )


def clamped_days() -> Column:
    """Days from transaction to maturity, never negative; null stays null.

    ``greatest`` would turn null into 0, so the floor is a conditional.
    """
    days = F.datediff("maturity_date", "transaction_date")
    return F.when(days < 0, 0).otherwise(days).cast("long")


def days_to_maturity(txn: DataFrame) -> DataFrame:
    return txn.withColumn("days_to_maturity", clamped_days())


def clean(txn: DataFrame, impute_days: int = IMPUTE_DAYS) -> DataFrame:
    return (
        txn.transform(parse_dates)
        .transform(normalize_zip)
        .transform(impute_maturity, impute_days)
        .transform(days_to_maturity)
        .drop("zip_candidate", "maturity_parsed")
    )


def valid_zips(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col("_zip_invalid_flag") == 0)
