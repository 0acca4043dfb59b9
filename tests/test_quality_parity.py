import pytest
from conftest import rows
from pyspark.sql import functions as F

from salesflow.operators import clean, enrich, parity, quality
from salesflow.plans import pipeline
from salesflow.plans.state import to_state
from salesflow.schemas import STATE_KEYS
from salesflow.sources.lookups import Lookups

TXN = [
    ("c", "2025-10-01", "SKU_1", 1, 1.0, None, "94105"),
    ("c", "2025-10-01", "SKU_1", 1, 1.0, "2025-10-09", "10001"),
    ("c", "2025-10-01", "SKU_4", 1, 1.0, "junk", "55555"),
    ("c", "2025-10-02", "SKU_9", 1, 1.0, "2025-10-09", "99999"),
    ("c", "2025-10-02", None, 1, 1.0, "2025-10-09", "INVALID_ZIP"),
    ("c", "2025-10-02", "SKU_1", 1, 1.0, None, None),
]


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_single_pass_report_equals_the_two_counters(txn_frame, lookup_frames, repeated, small):
    sku, zips = lookup_frames
    if repeated:
        sku, zips = sku.union(sku), zips.union(zips.filter("zip_code in ('94105', '55555')"))
    lookups = Lookups.measured(sku, zips) if small else Lookups(sku, zips)
    cleaned = clean.clean(txn_frame(TXN))
    enriched = enrich.enrich_zip(enrich.enrich_sku(clean.valid_zips(cleaned), sku), zips)
    expected = quality.quality_base(cleaned).first().asDict() | quality.quality_join(enriched).first().asDict()
    assert quality.quality_report(cleaned, lookups).first().asDict() == expected
    if not repeated:
        assert tuple(expected.values()) == (6, 2, 3, 4, 2, 2)
        assert expected["rows_input"] - expected["invalid_zip_dropped"] == expected["rows_after_join"]


def test_counters_of_an_empty_input_are_zero(txn_frame, lookups):
    report = quality.quality_report(clean.clean(txn_frame([])), lookups).first()
    assert set(report.asDict().values()) == {0}


def test_constraint_check_finds_duplicates_and_nulls(txn_frame, lookups):
    state = to_state(pipeline.sales(txn_frame(TXN), lookups), "c")
    assert set(quality.constraint_check(state, STATE_KEYS).first().asDict().values()) == {0, state.count()}
    broken = state.union(state.limit(1)).withColumn("sku_group", F.lit(None).cast("string"))
    check = quality.constraint_check(broken, STATE_KEYS).first()
    assert check["null_sku_group"] == state.count() + 1
    assert check["surplus_rows"] >= 1 and check["duplicate_keys"] >= 1


@pytest.fixture
def sales(txn_frame, lookups):
    return pipeline.sales(txn_frame(TXN), lookups)


def test_equal_frames_pass(sales):
    summary = parity.parity_summary(sales, sales).first()
    assert summary["parity_pass"] and summary["keys_compared"] == sales.count()
    assert parity.parity_diff(sales, sales).count() == 0


def test_empty_sides_pass(sales):
    nothing = sales.filter("false")
    assert parity.parity_summary(nothing, nothing).first()["parity_pass"]
    assert parity.parity_summary(nothing, sales).first()["parity_pass"]
    assert not parity.parity_summary(sales, nothing).first()["parity_pass"]


def test_tiny_differences_pass(sales):
    nudged = sales.withColumn("total_revenue", F.col("total_revenue") + 1e-9)
    assert parity.parity_summary(nudged, sales).first()["parity_pass"]
    assert parity.parity_diff(nudged, sales).count() == 0


@pytest.mark.parametrize(
    "metric", ["total_quantity", "total_revenue", "order_count", "avg_quantity_per_order", "avg_order_value",
               "days_to_maturity", "revenue_share_of_day", "revenue_rank"],
)
def test_one_changed_metric_is_found(sales, metric):
    target = F.col("sku_group") == "Alpha"
    changed = sales.withColumn(metric, F.when(target, F.col(metric) + 1).otherwise(F.col(metric)))
    summary = parity.parity_summary(changed, sales).first()
    assert not summary["parity_pass"] and summary[f"differs_{metric}"] == sales.filter(target).count()
    assert rows(parity.parity_diff(changed, sales).select("sku_group").distinct()) == [("Alpha",)]


def test_missing_rows_are_found_on_either_side(sales):
    fewer = sales.filter("sku_group <> 'Alpha'")
    gone = sales.count() - fewer.count()
    assert parity.parity_summary(fewer, sales).first()["only_in_baseline"] == gone
    assert parity.parity_summary(sales, fewer).first()["only_in_incremental"] == gone
    assert rows(parity.parity_diff(sales, fewer).select("found_in").distinct()) == [("incremental",)]
    assert parity.parity_head(parity.parity_diff(fewer, sales), 1).count() == 1


def test_null_metrics_and_keys_match_each_other(sales):
    blank = sales.withColumn("avg_order_value", F.lit(None).cast("double")).withColumn("transaction_date", F.lit(None).cast("date"))
    assert parity.parity_summary(blank, blank).first()["parity_pass"]
    half = blank.withColumn("avg_order_value", F.lit(1.0))
    assert parity.parity_summary(half, blank).first()["differs_avg_order_value"] == sales.count()


def test_one_day_only(sales):
    changed = sales.withColumn("total_quantity", F.when(F.dayofmonth("transaction_date") == 1, 99).otherwise(F.col("total_quantity")))
    assert parity.parity_summary(changed, sales, "2025-10-02").first()["parity_pass"]
    assert not parity.parity_summary(changed, sales, "2025-10-01").first()["parity_pass"]
