import random
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from salesflow.operators import aggregate, clean
from salesflow.operators.quality import quality_report
from salesflow.plans import pipeline
from salesflow.schemas import SALES_COLUMNS
from salesflow.sources.lookups import Lookups


@pytest.fixture
def mixed(txn_frame):
    draw = random.Random(7)
    codes = ["94105", "10001-1234", "INTL 00000", "55555", "99999", "bad", None]
    skus = [f"SKU_{i}" for i in range(1, 7)] + [None]
    return txn_frame(
        [
            (
                f"client_{draw.randint(1, 2)}",
                f"2025-10-{draw.randint(1, 3):02d}",
                draw.choice(skus),
                draw.choice([None, 1, 2, 3]),
                draw.choice([None, 5.0, 7.25, 499.99, -2.5]),
                draw.choice([None, "2025-10-09", "2025-09-01", "junk"]),
                draw.choice(codes),
            )
            for _ in range(600)
        ]
    )


def variants(sku, zips):
    measured = Lookups.measured(sku, zips)
    assert measured.sku_small and measured.zip_small and measured.few_groups and measured.few_categories
    return [
        measured,
        Lookups(sku, zips),
        replace(measured, few_categories=False, few_groups=False),
        replace(measured, sku_small=False),
        Lookups.measured(sku, zips, broadcast_limit=0, group_limit=0),
    ]


@pytest.mark.parametrize("by", [(), ("client_id",)])
@pytest.mark.parametrize("repeated", [False, True])
def test_all_paths_agree(mixed, lookup_frames, by, repeated):
    sku, zips = lookup_frames
    if repeated:
        sku, zips = sku.union(sku.filter("sku_id = 'SKU_1'")), zips.union(zips.filter("zip_code = '94105'"))
    results = [rows(pipeline.sales(mixed, v, by)) for v in variants(sku, zips)]
    assert results[0] and all(r == results[0] for r in results[1:])


@pytest.mark.parametrize("by", [(), ("client_id",)])
@pytest.mark.parametrize("repeated", [False, True])
def test_one_pass_gives_result_and_counters(spark, mixed, lookup_frames, by, repeated):
    """By every form, also when lookup keys repeat and joins multiply rows."""
    sku, zips = lookup_frames
    if repeated:
        sku, zips = sku.union(sku.filter("sku_id < 'SKU_3'")), zips.union(zips.filter("zip_code = '94105'"))
    cleaned = clean.clean(mixed)
    measured, _, _, large_sku, large = variants(sku, zips)
    for lookups in (measured, large_sku, large):
        made = pipeline.run(mixed, lookups, by)
        assert rows(made.aggregated) == rows(pipeline.sales(mixed, lookups, by))
        assert made.quality.first() == quality_report(cleaned, lookups).first()
        made.scratch.drop()


def test_one_pass_over_nothing_counts_zeros(txn_frame, lookups):
    made = pipeline.run(txn_frame([]), lookups)
    assert made.aggregated.count() == 0 and set(made.quality.first()) == {0}
    bad = pipeline.run(txn_frame([("c", "2025-10-01", "SKU_1", 1, 1.0, None, "bad")] * 3), lookups)
    assert bad.aggregated.count() == 0 and bad.quality.first().asDict() == {
        "rows_input": 3, "invalid_zip_dropped": 3, "maturity_imputed": 3, "rows_after_join": 0, "zip_lookup_miss": 0, "sku_lookup_miss": 0,
    }


def test_against_plain_python(mixed, lookups):
    sku = {r["sku_id"]: r for r in lookups.sku.collect()}
    zips = {r["zip_code"]: r for r in lookups.zip.collect()}
    groups = {}
    for r in clean.clean(mixed).collect():
        if r["_zip_invalid_flag"]:
            continue
        s, z = sku.get(r["sku_id"]), zips.get(r["zip_code"])
        local = bool(z and z["is_us"] and z["state"] == "CA")
        group = (s and s["sku_group"]) or "UNKNOWN"
        key = (str(r["transaction_date"]), str(r["maturity_date"]), group, local)
        groups.setdefault(key, []).append((r, (s and s["category"]) or "Unassigned", bool(s and s["is_high_priority"])))

    expected = []
    for key, members in groups.items():
        quantity = [m[0]["quantity_sold"] for m in members if m[0]["quantity_sold"] is not None]
        cents = [round(m[0]["revenue_usd"] * 100) for m in members if m[0]["revenue_usd"] is not None]
        days = [m[0]["days_to_maturity"] for m in members]
        expected.append(
            key
            + (
                min(m[1] for m in members),
                max(m[2] for m in members),
                sum(quantity),
                sum(cents) / 100.0,
                len(members),
                sum(quantity) / len(quantity) if quantity else None,
                sum(cents) / 100.0 / len(cents) if cents else None,
                sum(days) / len(days),
            )
        )
    found = aggregate.sales_aggregate(clean.clean(mixed), lookups).select(*SALES_COLUMNS[:12])
    assert rows(found) == sorted(expected, key=repr)


def test_group_of_nulls_sums_to_zero(txn_frame, lookups):
    txn = txn_frame([("c", "2025-10-01", "SKU_1", None, None, None, "94105")])
    row = pipeline.sales(txn, lookups).first()
    assert (row["total_quantity"], row["total_revenue"], row["order_count"]) == (0, 0.0, 1)
    assert row["avg_quantity_per_order"] is None and row["avg_order_value"] is None
    assert row["revenue_share_of_day"] == 0.0 and row["revenue_rank"] == 1


def test_null_day_is_a_group(txn_frame, lookups):
    txn = txn_frame([("c", None, "SKU_1", 1, 1.0, None, "94105")] * 2)
    row = pipeline.sales(txn, lookups).first()
    assert row["transaction_date"] is None and row["days_to_maturity"] is None and row["order_count"] == 2


def test_empty_input(txn_frame, lookups):
    for variant in (lookups, Lookups(lookups.sku, lookups.zip)):
        empty = pipeline.sales(txn_frame([]), variant)
        assert empty.columns == SALES_COLUMNS and empty.count() == 0


def test_category_numbers_follow_category_order(lookups):
    found = {r["category"]: r["_category"] for r in aggregate.category_numbers(lookups.sku).collect()}
    assert found["Unassigned"] == 0
    assert sorted(found, key=found.get) == sorted(found)


def test_daily_totals(txn_frame):
    txn = txn_frame(
        [
            ("c", "2025-10-01", "SKU_1", 2, 10.0, None, None),
            ("c", "2025-10-01", "SKU_1", None, None, None, None),
            (None, None, "SKU_1", 1, 1.0, None, None),
        ]
    )
    assert rows(aggregate.daily_totals(txn)) == [("2025-10-01", 2, 10.0, 10.0, 2), (None, 1, 1.0, 1.0, 1)]
    assert rows(aggregate.daily_totals_nonnull(txn)) == [("2025-10-01", 2, 10.0, 10.0, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_sku_concentration_against_sorting(spark, seed):
    draw = random.Random(seed)
    hits = {f"SKU_{i}": draw.choice([1, 1, 2, 3, 50]) for i in range(draw.randint(1, 40))}
    txn = spark.createDataFrame([(s,) for s, n in hits.items() for _ in range(n)], "sku_id string")
    top = sorted(hits.values(), reverse=True)[: int(len(hits) * 0.2)]
    row = aggregate.sku_concentration(txn).first()
    assert row["top_weight"] == sum(top) and row["sku_count"] == len(hits)
    assert row["top_share"] == sum(top) / sum(hits.values())


def test_sums_do_not_depend_on_partitioning(mixed, lookups):
    once = rows(pipeline.sales(mixed, lookups))
    assert rows(pipeline.sales(mixed.repartition(13), lookups)) == once


def test_fine_amounts_are_summed_whole_or_fail(spark):
    frame = spark.createDataFrame([("2025-10-01", 1, usd) for usd in (0.004, 0.004, 0.004)], "transaction_date string, quantity_sold long, revenue_usd double")
    assert aggregate.daily_totals(frame).first()["total_revenue"] == 0.012
    for usd in (0.00004, 0.0000005, 1234.50000001):
        with pytest.raises(Exception, match="finer"):
            aggregate.daily_totals(frame.withColumn("revenue_usd", F.lit(usd))).collect()
    exact = [0.0, 19.99, -0.0001, 123456789.1234, 499.95, 0.07, 1e11]
    many = spark.createDataFrame([("2025-10-01", 1, usd) for usd in exact], frame.schema)
    assert aggregate.daily_totals(many).first()["total_revenue"] == sum(round(usd * 10_000) for usd in exact) / 10_000
