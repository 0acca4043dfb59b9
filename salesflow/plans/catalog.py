"""Every query by name. Each takes (spark, sf_dir), reads the given tables whole,
and returns a frame whose dates are ``yyyy-MM-dd`` text."""

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.operators import aggregate, clean, enrich, parity, quality, snapshots, synth, topk, windows
from salesflow.plans import pipeline
from salesflow.plans import state as states
from salesflow.plans.incremental import check_days, replay, run_batch
from salesflow.plans.pipeline import text_dates
from salesflow.schemas import GROUP_KEYS, STATE_KEYS, TRANSACTIONS
from salesflow.session import Scratch, workspace
from salesflow.sources import archive
from salesflow.sources import driver_tables as model
from salesflow.sources.export import write_csv
from salesflow.sources.landing import land, landed_days, read_landing
from salesflow.sources.tables import read_transactions

CLIENT = ["client_id"]
BASIC_METRICS = [
    "category",
    "is_high_priority",
    "total_quantity",
    "total_revenue",
    "order_count",
    "avg_quantity_per_order",
    "avg_order_value",
    "days_to_maturity",
]


# --- scans and filters ---


def txn_scan_typed(spark: SparkSession, sf: str) -> DataFrame:
    return model.transactions(spark, sf).select(TRANSACTIONS.fieldNames())


def csv_scan_typed(spark, sf):
    """The same rows by way of CSV files whose columns are in another order."""
    path = f"{workspace(spark, 'salesflow-csv')}/transactions"
    shuffled = model.transactions(spark, sf).select("client_id", *reversed(TRANSACTIONS.fieldNames()))
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    shuffled.write.options(header=True, **spaces).csv(path)
    return read_transactions(spark, path)


def sku_lookup(spark, sf):
    return model.sku_lookup(spark, sf)


def zip_lookup(spark, sf):
    return model.zip_lookup(spark, sf)


def date_filter_gt(spark, sf):
    lines = model.lines_only(spark, sf, after=model.FILTER_DATE)
    return clean.after_date(lines.select("transaction_id", "transaction_date", "sku_id", "quantity_sold"), model.FILTER_DATE)


def date_filter_sql(spark, sf):
    """The same kind of filter as SQL straight over a file; it reaches the scan."""
    return spark.sql(
        f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS quantity
        FROM parquet.`{sf}/lineitem.parquet` WHERE l_shipdate > TIMESTAMP_NTZ '1996-01-01 00:00:00'"""
    )


def snapshot_rows(spark, sf):
    return snapshots.snapshot_rows(model.transactions(spark, sf))


def late_rows(spark, sf):
    arrived = model.arrivals(model.transactions(spark, sf).select("client_id", "transaction_id", "transaction_date"))
    return snapshots.late_rows(arrived)


# --- row-level cleaning and enrichment ---


def parse_dates(spark, sf):
    dirty = model.lines_only(spark, sf, malformed=True)
    parsed = dirty.withColumn("maturity_text", F.col("maturity_date")).transform(clean.parse_dates)
    return text_dates(parsed.select("transaction_id", "transaction_date", "maturity_text", "maturity_parsed"))


def zip_normalize(spark, sf):
    cleaned = clean.normalize_zip(model.transactions(spark, sf))
    flag = F.col("_zip_invalid_flag").alias("zip_invalid")
    return cleaned.select("transaction_id", "zip_code_raw", "zip_candidate", "zip_code", flag)


def zip_valid_rows(spark, sf):
    return clean.valid_zips(_cleaned(spark, sf)).select("transaction_id", "zip_code")


def maturity_impute(spark, sf):
    imputed = F.col("_maturity_imputed_flag").alias("maturity_imputed")
    return text_dates(_cleaned(spark, sf).select("transaction_id", "maturity_date", imputed))


def days_to_maturity(spark, sf):
    return _cleaned(spark, sf).select("transaction_id", "days_to_maturity")


def enrich_sku(spark, sf):
    lookups = model.lookups(spark, sf)
    found = clean.valid_zips(_cleaned(spark, sf)).transform(enrich.enrich_sku, lookups.sku_side())
    miss = F.col("_sku_lookup_miss_flag").alias("sku_lookup_miss")
    return found.select("transaction_id", "sku_id", "sku_group", "category", "is_high_priority", miss)


def enrich_zip(spark, sf):
    lookups = model.lookups(spark, sf)
    found = clean.valid_zips(_cleaned(spark, sf)).transform(enrich.enrich_zip, lookups.zip_side())
    miss = F.col("_zip_lookup_miss_flag").alias("zip_lookup_miss")
    return found.select("transaction_id", "zip_code", "state", "city", "is_us", miss)


def local_flag(spark, sf):
    lookups = model.lookups(spark, sf)
    found = clean.valid_zips(_cleaned(spark, sf)).transform(enrich.enrich_zip, lookups.zip_side())
    return found.transform(enrich.local_flag).select("transaction_id", "state", "is_us", "local")


# --- quality ---


def quality_base(spark, sf):
    return quality.quality_base(_cleaned(spark, sf))


def quality_join(spark, sf):
    lookups = model.lookups(spark, sf)
    valid = clean.valid_zips(_cleaned(spark, sf))
    enriched = valid.transform(enrich.enrich_sku, lookups.sku_side()).transform(enrich.enrich_zip, lookups.zip_side())
    return quality.quality_join(enriched)


def quality_report(spark, sf):
    return quality.quality_report(_cleaned(spark, sf), model.lookups(spark, sf))


def quality_one_pass(spark, sf):
    """The same counters as measures of the full pipeline's own aggregation."""
    return pipeline.run(model.transactions(spark, sf), model.lookups(spark, sf)).quality


# --- aggregates and windows ---


def sales_aggregate(spark, sf):
    return text_dates(_aggregate(spark, sf).select(*GROUP_KEYS, *BASIC_METRICS))


def revenue_share(spark, sf):
    shared = windows.revenue_share(_aggregate(spark, sf))
    return text_dates(shared.select(*GROUP_KEYS, "total_revenue", "revenue_share_of_day"))


def revenue_rank(spark, sf):
    ranked = windows.revenue_rank(_aggregate(spark, sf))
    return text_dates(ranked.select(*GROUP_KEYS, "total_revenue", "revenue_rank"))


def full_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue, share and rank per day, maturity date, SKU group and locality."""
    return text_dates(_sales(spark, sf))


def multi_client_pipeline(spark, sf):
    return text_dates(_sales(spark, sf, by=CLIENT))


def daily_totals(spark, sf):
    return aggregate.daily_totals(model.lines_only(spark, sf))


def daily_totals_nonnull(spark, sf):
    return aggregate.daily_totals_nonnull(model.lines_only(spark, sf))


def sku_day_totals(spark, sf):
    return aggregate.sku_day_totals(model.lines_only(spark, sf))


def sku_concentration(spark, sf):
    return aggregate.sku_concentration(model.lines_only(spark, sf))


def full_pipeline_large(spark, sf):
    """The forms for lookups too large to send to every executor, on the same data."""
    return text_dates(pipeline.sales(model.transactions(spark, sf), _large(spark, sf)))


def revenue_rank_large(spark, sf):
    aggregated = aggregate.sales_aggregate(_cleaned(spark, sf), _large(spark, sf))
    ranked = windows.share_and_rank(aggregated, wide=True)
    return text_dates(ranked.select(*GROUP_KEYS, "total_revenue", "revenue_rank"))


def csv_sink_roundtrip(spark, sf):
    """The result written for inspection and read again."""
    path = f"{workspace(spark, 'salesflow-export')}/sales"
    result = full_pipeline(spark, sf)
    write_csv(result, path)
    return spark.read.schema(result.schema).option("header", True).csv(path)


# --- top slices and reports ---


def max_date(spark, sf):
    """The joins keep every row, so the latest day of what is aggregated is that of the aggregate."""
    return topk.max_date(clean.valid_zips(_cleaned(spark, sf)))


def top5_latest_day(spark, sf):
    return text_dates(topk.top_latest_day(_sales(spark, sf)))


def top5_one_pass(spark, sf):
    """From what a run stored, in the forms for lookups that are not broadcast."""
    return text_dates(pipeline.run(model.transactions(spark, sf), _large(spark, sf)).top_slice)


def top5_report(spark, sf):
    return text_dates(topk.top_report(topk.top_latest_day(_sales(spark, sf))))


def leaderboard_sku_group(spark, sf):
    return text_dates(topk.leaderboard(_aggregate(spark, sf)))


def locality_summary(spark, sf):
    """The given day's filter is put on the source as well, so only it is processed."""
    day = clean.on_date(model.transactions(spark, sf), model.LAST_DATE)
    summary = topk.locality_summary(pipeline.sales(day, model.lookups(spark, sf)), model.LAST_DATE)
    means = {c: F.round(c, 6) for c in ("avg_order_value", "avg_days_to_maturity")}
    return summary.withColumns(means)


# --- archives ---


def archive_roundtrip(spark, sf):
    """Cumulative snapshots of the last two days as zipped archives, found by name; of all of
    them only the newest one of each client is opened."""
    root = f"{workspace(spark, 'salesflow-archives')}/archives"
    txn = model.transactions(spark, sf)
    days = F.explode(F.array(*[F.lit(n) for n in (model.NUM_DAYS - 1, model.NUM_DAYS)]))
    first = F.lit(model.START_DATE).cast("date")
    snapshots_of = txn.withColumn("snapshot_day", days).filter(
        F.col("transaction_date").cast("date") < F.date_add(first, F.col("snapshot_day"))
    )
    archive.write_archives(snapshots_of, root)
    return archive.read_archives(spark, root).filter(F.col("snapshot_day") == model.NUM_DAYS)


# --- state and incremental runs ---


def state_projection(spark, sf):
    return states.to_state(_sales(spark, sf, by=CLIENT))


def last_processed_date(spark, sf):
    path = f"{workspace(spark, 'salesflow-high-water')}/processed_sales_v1"
    states.write_days(states.to_state(_sales(spark, sf, by=CLIENT)), path)
    return states.marks(spark, path)


def incremental_batch(spark, sf):
    """Only what is after the date, cut off at the scans of both tables."""
    new = clean.after_date(model.transactions(spark, sf, after=model.FILTER_DATE), model.FILTER_DATE)
    return text_dates(pipeline.sales(new, model.lookups(spark, sf)))


def state_after_replay(spark, sf):
    """Land the transactions once, then replay ten daily snapshots into the state."""
    root = workspace(spark, "salesflow-replay")
    land(model.transactions(spark, sf), f"{root}/landing")
    landed = read_landing(spark, f"{root}/landing")
    first = F.lit(model.START_DATE).cast("date")
    days = [r[0] for r in spark.range(model.NUM_DAYS).select(F.date_add(first, F.col("id").cast("int")).cast("string")).collect()]
    path = replay(spark, landed, model.lookups(spark, sf), root, model.CLIENTS, days, landed=landed_days(spark, f"{root}/landing"))
    return states.read_state(spark, path)


def incremental_landed(spark, sf):
    """One more day: landed rows, nine days stored, then a run over the tenth by high water."""
    root, landed, lookups = landed_state(spark, sf, "2025-10-09")
    run_batch(spark, landed, lookups, root, model.CLIENTS, landed=landed_days(spark, f"{root}/landing"))
    return states.read_state(spark, states.state_path(spark, root))


def changed_replay(spark, sf):
    """Snapshots in which some rows arrive a day late, each run in mode ``changed``."""
    root = workspace(spark, "salesflow-changed")
    arrived = model.arrivals(model.transactions(spark, sf))
    arrived.write.parquet(f"{root}/arrived")
    arrived = spark.read.schema(arrived.schema).parquet(f"{root}/arrived")
    for day in ("2025-10-04", "2025-10-05", model.LAST_DATE):
        seen = arrived.filter(F.col("arrival_day") <= day).drop("arrival_day")
        run_batch(spark, seen, model.lookups(spark, sf), root, model.CLIENTS, mode="changed")
    return states.read_state(spark, states.state_path(spark, root))


def state_rebuild_client(spark, sf):
    """A client's days dropped and stored anew, among those of others."""
    path = f"{workspace(spark, 'salesflow-rebuild')}/processed_sales_v1"
    # used three times, computed once
    batch = Scratch(spark)(states.to_state(_sales(spark, sf, by=CLIENT)), "batch")
    states.write_days(batch.withColumn("total_quantity", F.lit(0).cast("long")).filter("client_id = 'client_1'"), path)
    states.write_days(batch.filter("client_id <> 'client_1'"), path)
    states.rebuild_client(batch, path, "client_1")
    return states.read_state(spark, path)


def state_schema_drift(spark, sf):
    """A stored table of another schema is left alone, and the state is built beside it."""
    root = workspace(spark, "salesflow-drift")
    batch = states.to_state(_sales(spark, sf, by=CLIENT))
    batch.drop("revenue_rank").write.partitionBy(*CLIENT, "transaction_date").parquet(f"{root}/processed_sales_v1")
    path = states.state_path(spark, root)
    states.write_days(batch, path)
    return states.read_state(spark, states.state_path(spark, root))


def state_constraint_check(spark, sf):
    return quality.constraint_check(states.to_state(_sales(spark, sf, by=CLIENT)), STATE_KEYS)


# --- parity ---


def parity_summary(spark, sf):
    sales = _sales(spark, sf)
    return parity.parity_summary(model.perturbed(sales), sales)


def parity_diff(spark, sf):
    sales = _sales(spark, sf)
    return text_dates(parity.parity_diff(model.perturbed(sales), sales))


def parity_head(spark, sf):
    """The first differences by key."""
    sales = _sales(spark, sf)
    return text_dates(parity.parity_head(parity.parity_diff(model.perturbed(sales), sales)))


def stored_day_parity(spark, sf):
    """Every client-day of a state that differs on purpose, against its recomputation in one job."""
    state = Scratch(spark)(states.to_state(model.perturbed(_sales(spark, sf, by=CLIENT))), "state")
    return check_days(model.transactions(spark, sf), model.lookups(spark, sf), state)


# --- synthetic data: one generated row per line item, from the given lookups ---


def synth_transactions(spark, sf):
    rows, bits = _synth_size(spark, sf)
    per_day = max(1, rows // 100)
    first_day = rows - per_day * (model.NUM_DAYS - 1)
    return synth.transactions(spark.range(rows), model.lookups(spark, sf), first_day, per_day, bits)


def synth_zip_noise(spark, sf):
    rows, bits = _synth_size(spark, sf)
    return synth.with_noisy_zip(spark.range(rows), model.lookups(spark, sf), bits)


def synth_maturity(spark, sf):
    """A maturity date for every line item, from its number and day."""
    lines = model.lines_only(spark, sf)
    number = F.substring("transaction_id", 5, 20).cast("long")
    day = F.col("transaction_date").cast("date")
    return lines.select(number.alias("id"), "transaction_date", synth.maturity_text(day, number).alias("maturity_date"))


def landed_state(spark, sf, upto):
    """Landed transactions, and the state of all days up to one: (root, landed, lookups)."""
    root, lookups = workspace(spark, "salesflow-landed"), model.lookups(spark, sf)
    land(model.transactions(spark, sf), f"{root}/landing")
    landed = read_landing(spark, f"{root}/landing")
    run_batch(spark, snapshots.snapshot(landed, upto), lookups, root, model.CLIENTS)
    return root, landed, lookups


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [
        txn_scan_typed, sku_lookup, zip_lookup, date_filter_gt, date_filter_sql, snapshot_rows, late_rows,
        parse_dates, zip_normalize, zip_valid_rows, maturity_impute, days_to_maturity,
        enrich_sku, enrich_zip, local_flag, quality_base, quality_join, quality_report,
        sales_aggregate, revenue_share, revenue_rank, full_pipeline, multi_client_pipeline,
        daily_totals, daily_totals_nonnull, sku_day_totals, sku_concentration,
        top5_latest_day, top5_report, leaderboard_sku_group, locality_summary,
        state_projection, last_processed_date, incremental_batch, state_after_replay, state_constraint_check,
        parity_summary, parity_diff, synth_transactions, synth_zip_noise, synth_maturity,
        csv_scan_typed, full_pipeline_large, revenue_rank_large, csv_sink_roundtrip, max_date, parity_head,
        incremental_landed, changed_replay, state_rebuild_client, state_schema_drift,
        quality_one_pass, top5_one_pass, archive_roundtrip, stored_day_parity,
    ]
    return {query.__name__: query for query in listed}


def _cleaned(spark, sf):
    return clean.clean(model.transactions(spark, sf))


def _aggregate(spark, sf):
    return aggregate.sales_aggregate(_cleaned(spark, sf), model.lookups(spark, sf))


def _sales(spark, sf, by=()):
    return pipeline.sales(model.transactions(spark, sf), model.lookups(spark, sf), by)


def _large(spark, sf):
    """The lookups as if they were past every limit."""
    return replace(model.lookups(spark, sf), sku_small=False, zip_small=False, few_groups=False, few_categories=False)


def _synth_size(spark, sf):
    """Row count from file metadata, and slices for the larger lookup."""
    keys = max(model.table(spark, sf, name).count() for name in ("part", "customer"))
    return model.table(spark, sf, "lineitem").count(), synth.slice_bits(keys)
