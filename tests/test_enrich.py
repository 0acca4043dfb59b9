import pytest
from conftest import rows

from salesflow.operators import clean, enrich, reduction


def enriched(txn, lookups):
    valid = clean.valid_zips(clean.clean(txn))
    with_sku = enrich.enrich_sku(valid, lookups.sku_side())
    return enrich.local_flag(enrich.enrich_zip(with_sku, lookups.zip_side()))


def test_sku_match_miss_and_null_group(txn_frame, lookups):
    txn = txn_frame([("c", "2025-10-01", s, 1, 1.0, None, "94105") for s in ("SKU_1", "SKU_4", "SKU_9", None)])
    found = rows(enriched(txn, lookups), "sku_id", "sku_group", "category", "is_high_priority", "_sku_lookup_miss_flag")
    assert found == [
        ("SKU_1", "Alpha", "Toys", True, 0),
        ("SKU_4", "UNKNOWN", "Unassigned", False, 1),
        ("SKU_9", "UNKNOWN", "Unassigned", False, 1),
        (None, "UNKNOWN", "Unassigned", False, 1),
    ]


def test_zip_match_miss_and_local(txn_frame, lookups):
    txn = txn_frame([("c", "2025-10-01", "SKU_1", 1, 1.0, None, z) for z in ("94105", "10001", "00000", "55555", "99999")])
    found = rows(enriched(txn, lookups), "zip_code", "city", "state", "is_us", "local", "_zip_lookup_miss_flag")
    assert found == [
        ("00000", "Abroad", "CA", False, False, 0),
        ("10001", "New York", "NY", True, False, 0),
        ("55555", "Unknown", "UNKNOWN", False, False, 1),
        ("94105", "San Francisco", "CA", True, True, 0),
        ("99999", "Unknown", "UNKNOWN", False, False, 1),
    ]


def test_repeated_lookup_key_multiplies_rows(txn_frame, lookups):
    txn = txn_frame([("c", "2025-10-01", "SKU_1", 1, 1.0, None, "94105")])
    valid = clean.valid_zips(clean.clean(txn))
    assert enrich.enrich_sku(valid, lookups.sku.union(lookups.sku)).count() == 2


@pytest.mark.parametrize("bits", [15, 18, 24])
def test_bitmaps_miss_no_key(spark, bits):
    """Every key is found; of others few are, while the filter is not full."""
    lookup = spark.range(3000).selectExpr("if(id = 7, null, concat('K', id)) as k", "id as v")
    bitmaps = reduction.key_bitmaps(lookup, "k", bits)
    assert bitmaps.count() <= 2 ** (bits - reduction.BITMAP_BITS)
    probes = spark.range(6000).selectExpr("if(id = 5999, null, concat('K', id)) as k", "id")
    found = reduction.with_match(probes, bitmaps, "k", bits).collect()
    may = {r["id"] for r in found if r["_may_match"]}
    assert len(found) == 6000 and may >= set(range(3000)) - {7} and 5999 not in may
    assert len([i for i in may if i >= 3000]) < 3000 * (0.12 if bits == 15 else 0.03)


def test_rows_without_a_match_are_not_shuffled(spark):
    lookup = spark.range(2000).selectExpr("concat('S', id) as sku_id", "'G' as sku_group", "'C' as category", "true as is_high_priority")
    twice = lookup.unionByName(lookup.filter("sku_id = 'S5'"))
    facts = spark.range(5000).selectExpr("id", "if(id % 10 = 0, null, concat('S', id)) as sku_id")
    plain = enrich.enrich_sku(facts, twice)
    reduced = reduction.reduced_join(facts, twice, "sku_id", 2001, enrich.enrich_sku)
    assert sorted(plain.columns) == sorted(reduced.columns)
    assert rows(reduced.select(plain.columns)) == rows(plain)
    shuffled = []
    reduction.reduced_join(facts, twice, "sku_id", 2001, lambda left, right: shuffled.append(left) or enrich.enrich_sku(left, right))
    assert 1800 <= shuffled[0].count() < 2100 and shuffled[0].count() + shuffled[1].count() == 5000
    plan = enrich.enrich_sku(shuffled[1], twice.filter("false"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of the bitmaps alone
