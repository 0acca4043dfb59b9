import pytest
from conftest import rows
from pyspark.sql import functions as F

from salesflow.functions import lenient_date
from salesflow.operators import clean

ZIP_CASES = [
    ("12345-6789", "12345", "12345", 0),
    (" 94105  ", "94105", "94105", 0),
    ("941 05", "94105", "94105", 0),
    ("ZIP94105", "94105", "94105", 0),
    ("zip94105", "94105", "94105", 0),
    ("INTL 00000", "00000", "00000", 0),
    ("INVALID_ZIP", "", None, 1),
    (None, "", None, 1),
    ("", "", None, 1),
    ("1234", "1234", None, 1),
    ("1A2345", "12345", "12345", 0),
    ("１２３４５", "", None, 1),
    ("1234567", "12345", "12345", 0),
    ("ß9-4:1\n0é5", "94105", "94105", 0),
]


def test_zip_cleaning(spark):
    raw = spark.createDataFrame([(i, case[0]) for i, case in enumerate(ZIP_CASES)], "i int, zip_code_raw string")
    found = clean.normalize_zip(raw).orderBy("i").drop("i")
    assert [tuple(r) for r in found.collect()] == ZIP_CASES


MATURITY_CASES = [
    ("2025-10-04", "2025-10-14", "2025-10-14", 0, 10),
    ("2025-10-04", "2025-10-04", "2025-10-04", 0, 0),
    ("2025-10-04", "2025-10-01", "2025-10-01", 0, 0),
    ("2025-10-04", "2026-02-01", "2026-02-01", 0, 120),
    ("2025-10-04", None, "2025-10-07", 1, 3),
    ("2025-10-04", "", "2025-10-07", 1, 3),
    ("2025-10-04", "2025-13-01", "2025-10-07", 1, 3),
    ("2025-10-04", "2025-02-30", "2025-10-07", 1, 3),
    ("2025-10-04", "2025-1-5", "2025-10-07", 1, 3),
    ("2025-10-04", "2025-10-1 ", "2025-10-07", 1, 3),
    ("2025-10-04", " 2025-10-01", "2025-10-07", 1, 3),
    ("2025-10-04", "2025-10-01x", "2025-10-07", 1, 3),
    ("2025-10-04", "2025-10-01T00:00:00", "2025-10-07", 1, 3),
    (None, None, None, 1, None),
    (None, "2025-10-14", "2025-10-14", 0, None),
]


def test_maturity(txn_frame):
    txn = txn_frame([("c", day, "SKU_1", 1, 1.0, raw, "94105") for day, raw, *_ in MATURITY_CASES])
    found = clean.clean(txn).orderBy("transaction_id").select(
        F.col("maturity_date").cast("string"), "_maturity_imputed_flag", "days_to_maturity"
    )
    assert [tuple(r) for r in found.collect()] == [case[2:] for case in MATURITY_CASES]


def test_impute_days_is_a_parameter(txn_frame):
    txn = txn_frame([("c", "2025-10-04", "SKU_1", 1, 1.0, None, "94105")])
    assert clean.clean(txn, impute_days=10).first()["days_to_maturity"] == 10


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("bad", ["2025-13-01", "soon", "2025-1-5", "2025-10-01x"])
def test_bad_transaction_date_fails_the_run(spark, txn_frame, bad, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        txn = txn_frame([("c", bad, "SKU_1", 1, 1.0, None, "94105")])
        with pytest.raises(Exception, match="not a yyyy-MM-dd date"):
            clean.clean(txn).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_high_water_filters(txn_frame):
    days = ["2025-10-04", "2025-10-05", "2025-10-06", None]
    txn = txn_frame([("c", d, "SKU_1", 1, 1.0, None, "94105") for d in days])
    assert rows(clean.after_date(txn, "2025-10-05"), "transaction_date") == [("2025-10-06",)]
    assert rows(clean.from_date(txn, "2025-10-05"), "transaction_date") == [("2025-10-05",), ("2025-10-06",)]
    assert clean.after_date(txn, None).count() == 4


def test_clean_drops_its_helpers(txn_frame):
    columns = clean.clean(txn_frame([])).columns
    assert not {"zip_candidate", "maturity_parsed", "_transaction_parsed"} & set(columns)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_only_dates_written_out_in_full_are_read(spark, ansi):
    """The rule is that the date written out is the text again."""
    odd = [" 025-10-05", "+025-10-05", "2025-10-5T", "2025-10- 5", "2025-10-T5", "2025-1 -05", "2025-1T-05", "20251-0-05", "2025-10-05", "0001-01-01",
           "2025-02-29", "2024-02-29", "2025/10/05", "2025-10-0\\n", "２025-10-05", "2025-10-0５", "-025-10-05", "2025-10-5 ", "0000-01-01", "2025-1-005",
           "2025--1-05", "20a5-10-05", "2025-10-32", "2025-10-05T", "        -1", "", None]
    texts = spark.createDataFrame([(t,) for t in odd], "text string")
    parsed = texts.select("text", lenient_date(F.col("text")).cast("string").alias("date"), F.expr("try_cast(text as date)").cast("string").alias("as_cast"))
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        found = parsed.collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert [r["date"] for r in found] == [r["text"] if r["text"] and r["as_cast"] == r["text"] else None for r in found]
    assert [r["date"] for r in found if r["date"]] == ["2025-10-05", "0001-01-01", "2024-02-29", "0000-01-01"]
