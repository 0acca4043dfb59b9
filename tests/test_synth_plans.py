import re

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from salesflow.functions import digest, lane, uniform
from salesflow.operators import aggregate, clean, synth
from salesflow.plans import catalog, pipeline
from salesflow.session import Scratch
from salesflow.sources import driver_tables as model
from salesflow.sources.lookups import Lookups

ROWS = 40_000


@pytest.fixture(scope="module")
def lookups(spark):
    return model.lookups(spark, SMALL)


@pytest.fixture(scope="module")
def made(spark, lookups):
    frame = synth.transactions(spark.range(ROWS), lookups, ROWS - 900, 100, bits=9)
    return frame.cache()


def test_one_row_per_id_whatever_the_partitioning(spark, lookups, made):
    assert made.count() == ROWS
    assert made.select("transaction_id").distinct().count() == ROWS
    other = synth.transactions(spark.range(ROWS).repartition(7), Lookups(lookups.sku, lookups.zip), ROWS - 900, 100, bits=12)
    assert other.exceptAll(made).count() == 0


def test_value_ranges_and_growth(made):
    r = made.agg(F.min("quantity_sold"), F.max("quantity_sold"), F.min("revenue_usd"), F.max("revenue_usd")).first()
    assert tuple(r)[:2] == (1, 10) and 5.0 <= r[2] < 6 and 499 < r[3] <= 500.0
    per_day = [r[1] for r in sorted(made.groupBy("transaction_date").count().collect())]
    assert per_day == [ROWS - 900] + [100] * 9


def test_noise_shares(made):
    raw = F.col("zip_code_raw")
    found = made.agg(
        F.avg(raw.rlike(r"^\d{5}-\d{4}$").cast("int")).alias("zip4"),
        F.avg(raw.rlike(r"^ .*  $").cast("int")).alias("spaces"),
        F.avg((raw == "INTL 00000").cast("int")).alias("intl"),
        F.avg((raw == "INVALID_ZIP").cast("int")).alias("invalid"),
        F.avg(raw.startswith("ZIP").cast("int")).alias("prefix"),
        F.avg(raw.isNull().cast("int")).alias("null"),
    ).first()
    shares = {"zip4": 0.2 / 0.97, "spaces": 0.15 / 0.97, "intl": 0.05 / 0.97, "invalid": 0.04 / 0.97, "prefix": 0.07 / 0.97, "null": 0.03}
    for name, share in shares.items():
        assert abs(found[name] - share) < 0.01, name


def test_maturity_shares(made):
    offset = F.datediff(F.col("maturity_date").cast("date"), F.col("transaction_date").cast("date"))
    r = made.agg(
        F.avg(F.col("maturity_date").isNull().cast("int")),
        F.avg((offset < 0).cast("int")),
        F.avg((offset >= 45).cast("int")),
        F.min(offset),
        F.max(offset),
    ).first()
    assert abs(r[0] - 0.04) < 0.01 and abs(r[1] - 0.03) < 0.01 and abs(r[2] - 0.04) < 0.01
    assert r[3] == -4 and r[4] == 119


def test_draws_follow_the_weights(lookups, made):
    weights = {r[0]: r[1] for r in synth.sku_weights(lookups.sku).collect()}
    total = sum(weights.values())
    hits = {r[0]: r[1] for r in made.groupBy("sku_id").count().collect()}
    assert set(hits) <= set(weights)
    for sku, weight in weights.items():
        p = weight / total
        assert abs(hits.get(sku, 0) / ROWS - p) < 5 * (p * (1 - p) / ROWS) ** 0.5 + 1e-4


def test_pieces_cover_the_line_once(lookups):
    for weighted, key in ((synth.sku_weights(lookups.sku), "sku_id"), (synth.zip_weights(lookups.zip), "zip_code")):
        pieces = sorted((r["lo"], r["hi"]) for r in synth.weight_intervals(weighted, key).collect())
        assert pieces[0][0] == 0 and pieces[-1][1] == 2**synth.LINE_BITS
        assert all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))


def test_every_key_can_be_drawn(spark):
    """Among 100,000 keys, from one unit of weight to ten billion; each is found at both ends of its piece."""
    keys = spark.range(100_000).selectExpr("concat('K', id) as k", "if(id % 10 = 0, 1L, pow(10, id % 11)) as w")
    intervals = synth.weight_intervals(keys.select("k", F.col("w").cast("long").alias("weight")), "k").cache()
    assert intervals.filter("hi <= lo").count() == 0
    aimed = intervals.select(F.col("k").alias("wanted"), F.explode(F.array("lo", F.col("hi") - 1)).alias("at"))
    found = synth.sample_weighted(aimed, F.col("at"), intervals, "k", synth.slice_bits(100_000), False)
    assert found.count() == 200_000 and found.filter("k <> wanted").count() == 0


def test_lanes_look_uniform_and_independent(spark):
    d = digest(F.col("id"), "x")
    u = [uniform(d, i) for i in range(4)]
    r = spark.range(20_000).agg(*[F.avg(x) for x in u], F.corr(u[0], u[1]), F.corr(u[2], u[3])).first()
    assert all(abs(v - 0.5) < 0.01 for v in r[:4]) and all(abs(v) < 0.03 for v in r[4:])
    with pytest.raises(ValueError):
        lane(d, 4)


def test_filter_rows(spark):
    flat = synth.filter_rows(spark.range(10_000))
    assert flat.columns == ["transaction_id", "transaction_date", "sku_id", "quantity"]
    assert flat.select("transaction_date").distinct().count() == 10
    share = clean.after_date(flat, "2025-10-05").count() / 10_000
    assert abs(share - 0.5) < 0.03


# --- plans ---


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_large_form_reads_the_transactions_once(spark, monkeypatch):
    """The result, its ranks and its counters start from what was stored."""
    plans, store = [], Scratch.__call__

    def seen(self, frame, name):
        plans.append(plan(frame))
        return store(self, frame, name)

    monkeypatch.setattr(Scratch, "__call__", seen)
    for build in (catalog.full_pipeline_large, catalog.quality_one_pass, catalog.top5_one_pass):
        plans.clear()
        plans.append(plan(build(spark, SMALL)))
        assert sum(len(re.findall(r"FileScan parquet.*lineitem", p)) for p in plans) == 1, build.__name__


@pytest.mark.parametrize("name", ["full_pipeline", "multi_client_pipeline", "daily_totals", "quality_report", "late_rows", "state_constraint_check", "leaderboard_sku_group", "locality_summary"])
def test_aggregates_are_hashed(spark, name):
    assert "SortAggregate" not in plan(catalog.queries()[name](spark, SMALL))


def test_no_query_multiplies_tables(spark):
    for name in ("full_pipeline", "parity_diff", "late_rows", "top5_latest_day", "synth_transactions", "quality_report"):
        found = plan(catalog.queries()[name](spark, SMALL))
        assert "CartesianProduct" not in found and "NestedLoop" not in found, name


def test_pipeline_exchanges(spark, txn_frame, lookups):
    """From landed rows: one exchange for the aggregate, one for both windows."""
    found = plan(pipeline.sales(txn_frame([]).repartition(4), lookups))
    assert found.count("Exchange hashpartitioning(transaction_date") == 2
    assert "hashpartitioning(sku_id" not in found and "hashpartitioning(zip_code" not in found


def test_unmeasured_lookups_are_not_hinted(spark, txn_frame, lookups):
    unknown = Lookups(lookups.sku, lookups.zip)
    hints = aggregate.sales_aggregate(clean.clean(txn_frame([])), unknown)._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in hints


def test_scan_reads_only_what_is_used(spark):
    found = plan(catalog.full_pipeline(spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double,l_extendedprice:double>" in found
    sql = plan(catalog.date_filter_sql(spark, SMALL))
    assert "GreaterThan(l_shipdate" in sql
