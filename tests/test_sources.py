import os
import zipfile

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from salesflow.operators import clean
from salesflow.plans import pipeline
from salesflow.plans import state as states
from salesflow.schemas import TRANSACTIONS
from salesflow.session import workspace
from salesflow.sources import archive, export, landing, tables
from salesflow.sources.lookups import Lookups
from salesflow.streaming.arrivals import process_arrivals

HEADER = ",".join(TRANSACTIONS.fieldNames())
LINES = [
    "TXN_0000000000,2025-10-01,SKU_1,3,19.99,2025-10-14,94105-1234",
    "TXN_0000000001,2025-10-05,SKU_2,1,5.00,,",
    "TXN_0000000002,2025-10-06,SKU_9,10,500.00,2025-13-01,INTL 00000",
]
EXPECTED = [
    ("TXN_0000000000", "2025-10-01", "SKU_1", 3, 19.99, "2025-10-14", "94105-1234"),
    ("TXN_0000000001", "2025-10-05", "SKU_2", 1, 5.0, None, None),
    ("TXN_0000000002", "2025-10-06", "SKU_9", 10, 500.0, "2025-13-01", "INTL 00000"),
]


def write(path, lines, header=HEADER):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def zip_snapshot(root, client, day, lines):
    target = root / client / f"transactions_day_{day}.zip"
    target.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("first.csv", "\n".join([HEADER, *lines]) + "\n")
        z.writestr("second.csv", "not,read\n1,2\n")


def test_typed_csv_scan(spark, tmp_path):
    frame = tables.read_transactions(spark, write(tmp_path / "t.csv", LINES))
    assert frame.schema == TRANSACTIONS
    assert rows(frame) == EXPECTED


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    moved = write(tmp_path / "s.csv", ["S1,Alpha,Toys,TRUE"], "sku_id,category,sku_group,is_high_priority")
    assert tables.read_sku_lookup(spark, moved).first().asDict() == {
        "sku_id": "S1", "sku_group": "Toys", "category": "Alpha", "is_high_priority": True,
    }
    with pytest.raises(ValueError, match="sku_group"):
        tables.read_sku_lookup(spark, write(tmp_path / "m.csv", ["S1,Alpha,TRUE"], "sku_id,category,is_high_priority"))


def test_wrong_type_in_csv_fails(spark, tmp_path):
    bad = write(tmp_path / "t.csv", ["TXN_1,2025-10-01,SKU_1,many,1.0,,94105"])
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        tables.read_transactions(spark, bad).collect()


def test_high_water_filter_reaches_the_csv_scan(spark, tmp_path):
    frame = clean.after_date(tables.read_transactions(spark, write(tmp_path / "t.csv", LINES)), "2025-10-04")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(transaction_date), GreaterThan(transaction_date,2025-10-04)]" in plan
    assert len(rows(frame)) == 2


def test_lookups_parse_flags_in_any_case(spark, tmp_path):
    sku = write(tmp_path / "s.csv", ["S1,G,C,TRUE", "S2,G,C,false", "S3,G,C,yes", "S4,G,C,"], "sku_id,sku_group,category,is_high_priority")
    zips = write(tmp_path / "z.csv", ["00501,Holtsville,NY,True", "00000,Abroad,XX,FALSE"], "zip_code,city,state,is_us")
    assert rows(tables.read_sku_lookup(spark, sku), "sku_id", "is_high_priority") == [
        ("S1", True), ("S2", False), ("S3", False), ("S4", None)]
    assert rows(tables.read_zip_lookup(spark, zips), "zip_code", "is_us") == [("00000", False), ("00501", True)]


def test_missing_lookup_fails_before_any_work(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        tables.read_sku_lookup(spark, str(tmp_path / "nowhere.csv"))


def test_lookup_sizes_decide(spark, lookup_frames):
    sku, zips = lookup_frames
    small = Lookups.measured(sku, zips)
    assert small.sku_small and small.zip_small and small.few_groups
    large = Lookups.measured(sku, zips, broadcast_limit=1, group_limit=1)
    assert not (large.sku_small or large.zip_small or large.few_groups or large.few_categories)
    empty = Lookups.measured(sku.filter("false"), zips.filter("false"))
    assert empty.sku_small and empty.zip_small and empty.few_groups


def test_archives_one_partition_each_first_member_only(spark, tmp_path):
    zip_snapshot(tmp_path, "client_1", 1, LINES[:1])
    zip_snapshot(tmp_path, "client_1", 2, LINES)
    zip_snapshot(tmp_path, "client_2", 1, LINES[:2])
    zip_snapshot(tmp_path, "client_2", 2, [])
    frame = archive.read_archives(spark, str(tmp_path), ["client_1", "client_2"], [1, 2])
    assert frame.rdd.getNumPartitions() == 4
    counts = {(r[0], r[1]): r[2] for r in frame.groupBy("client_id", "snapshot_day").count().collect()}
    assert counts == {("client_1", 1): 1, ("client_1", 2): 3, ("client_2", 1): 2}
    assert rows(frame.filter("client_id = 'client_1' and snapshot_day = 2").drop("client_id", "snapshot_day")) == EXPECTED


def test_archives_are_found_and_filters_choose_them(spark, tmp_path):
    for client in ("client_1", "client_2"):
        for day in (1, 2, 10):
            zip_snapshot(tmp_path, client, day, LINES[: 1 + day % 3])
    (tmp_path / "client_1" / "notes.txt").write_text("no archive")
    # opening this one would fail
    (tmp_path / "client_2" / "transactions_day_3.zip").write_text("broken")
    frame = archive.read_archives(spark, str(tmp_path))
    newest = frame.filter("snapshot_day >= 10 and client_id in ('client_1', 'client_2')")
    assert newest.rdd.getNumPartitions() == 2 and newest.count() == 4
    assert frame.filter("snapshot_day = 2 and client_id = 'client_1' and quantity_sold > 1").rdd.getNumPartitions() == 1
    assert rows(frame.filter("snapshot_day = 2 and client_id = 'client_1'").select(TRANSACTIONS.fieldNames())) == EXPECTED
    assert frame.filter("snapshot_day < 0").count() == 0
    with pytest.raises(Exception, match="zip"):
        frame.count()


def test_archives_are_written_and_read_again(spark, tmp_path, txn_frame):
    root = str(tmp_path / "out")
    data = [(f"client_{k % 2}", f"2025-10-0{1 + k % 3}", f"S, \"{k}\"", None if k % 7 == 0 else k, k / 4, None, " 941\n05 ") for k in range(300)]
    txn = txn_frame(data).repartition(5)
    snapshots = txn.withColumn("snapshot_day", F.explode(F.sequence(F.substring("transaction_date", 10, 1).cast("int"), F.lit(3))))
    archive.write_archives(snapshots, root)
    names = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.*"))
    assert names == [f"client_{c}/transactions_day_{d}.zip" for c in (0, 1) for d in (1, 2, 3)]
    back = archive.read_archives(spark, root)
    assert rows(back.select(snapshots.columns)) == rows(snapshots)
    # a second write of a day replaces it; a failed one leaves all as it was
    archive.write_archives(snapshots.filter("snapshot_day = 1 and client_id = 'client_0'").limit(2), root)
    assert back.filter("snapshot_day = 1").groupBy("client_id").count().filter("client_id = 'client_0'").first()[1] == 2
    before = rows(archive.read_archives(spark, root))
    with pytest.raises(Exception, match="belongs to no archive"):
        archive.write_archives(snapshots.withColumn("client_id", F.when(F.col("quantity_sold") < 290, F.col("client_id"))), root)
    assert rows(archive.read_archives(spark, root)) == before


def test_missing_archive_fails(spark, tmp_path):
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        archive.read_archives(spark, str(tmp_path), ["client_1"], [3]).collect()


def test_csv_export_has_headers(spark, tmp_path, lookups, txn_frame):
    out = str(tmp_path / "out")
    txn = txn_frame([("c", "2025-10-01", "SKU_1", 2, 10.0, None, "94105")])
    export.write_csv(states.to_state(pipeline.sales(txn, lookups), "c"), out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == states.STATE.fieldNames() and back.count() == 1


def test_workspace_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    first, second = workspace(spark, "t"), workspace(spark, "t")
    assert first != second
    if shared:
        assert first.startswith(shared.rstrip("/"))


def test_arriving_archives_update_the_state(spark, tmp_path, lookups, txn_frame):
    incoming, landed, root, done = (str(tmp_path / n) for n in ("in", "landing", "root", "done"))
    zip_snapshot(tmp_path / "in", "client_1", 1, LINES[:1])

    def arrive():
        query = process_arrivals(spark, incoming, landed, root, lookups, done)
        query.awaitTermination(120)
        assert query.exception() is None

    def state():
        return rows(states.read_state(spark, states.state_path(spark, root)))

    def full():
        return rows(states.to_state(pipeline.sales(landing.read_landing(spark, landed), lookups, by=["client_id"])))

    arrive()
    assert state() == full() and len(state()) == 1
    zip_snapshot(tmp_path / "in", "client_1", 2, LINES)
    zip_snapshot(tmp_path / "in", "client_2", 1, LINES[:2])
    arrive()
    assert state() == full()
    assert {r[0] for r in state()} == {"client_1", "client_2"}
    assert landing.read_landing(spark, landed).count() == 5
    before = state()
    arrive()
    assert state() == before


@pytest.mark.parametrize("per_batch", [1, 100])
def test_an_older_snapshot_that_comes_later_changes_nothing(spark, tmp_path, lookups, per_batch):
    incoming, landed, root, done = (str(tmp_path / n) for n in ("in", "landing", "root", "done"))
    zip_snapshot(tmp_path / "in", "client_1", 2, LINES)
    zip_snapshot(tmp_path / "in", "client_1", 1, LINES[:1])
    for day, when in ((2, 1_000), (1, 2_000)):
        os.utime(tmp_path / "in" / "client_1" / f"transactions_day_{day}.zip", (when, when))
    query = process_arrivals(spark, incoming, landed, root, lookups, done, archives_per_batch=per_batch)
    query.awaitTermination(120)
    assert query.exception() is None
    assert landing.read_landing(spark, landed).count() == len(LINES)
