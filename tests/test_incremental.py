from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from salesflow.operators.snapshots import late_rows, snapshot, snapshot_rows
from salesflow.plans import incremental, pipeline
from salesflow.plans import state as states
from salesflow.sources.landing import land, landed_days, read_landing

CLIENTS = ["client_1", "client_2"]


def day(n):
    return f"2025-10-{n:02d}"


def txn_rows(days, clients=CLIENTS):
    return [
        (c, day(d), f"SKU_{1 + (d + i) % 5}", 1 + i, 5.0 * d + i, day(d + 3) if i else None, ["94105", "10001", "bad"][i % 3])
        for c in clients
        for d in days
        for i in range(4)
    ]


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "warehouse")


@pytest.fixture
def run(spark, lookups, root):
    def go(txn, mode="from", clients=CLIENTS):
        return incremental.run_batch(spark, txn, lookups, root, clients, mode)

    return go


@pytest.fixture
def stored(spark, root):
    return lambda: rows(states.read_state(spark, states.state_path(spark, root)))


@pytest.fixture
def recomputed(lookups):
    return lambda txn: rows(states.to_state(pipeline.sales(txn, lookups, by=["client_id"])))


def test_first_run_next_day_repeat_and_empty(spark, root, run, stored, recomputed, txn_frame):
    txn = txn_frame(txn_rows([1, 2, 3]))
    assert stored() == []
    first = run(snapshot(txn, day(2)))
    assert first.high_water == {"client_1": None, "client_2": None}
    assert stored() == recomputed(snapshot(txn, day(2)))
    second = run(txn)
    assert second.high_water == {c: day(2) for c in CLIENTS}
    assert {d for _, d in second.days} == {day(2), day(3)}
    after_two = stored()
    assert after_two == recomputed(txn)
    run(txn)
    assert stored() == after_two
    run(txn.filter("false"), mode="after")
    assert stored() == after_two


@pytest.mark.parametrize("mode", incremental.MODES)
def test_replay_equals_full_recompute(spark, lookups, root, stored, recomputed, txn_frame, mode):
    txn = txn_frame(txn_rows(range(1, 5)))
    incremental.replay(spark, txn, lookups, root, CLIENTS, [day(d) for d in range(1, 5)], mode)
    assert stored() == recomputed(txn)


def test_clients_at_different_days(run, stored, recomputed, txn_frame):
    one = txn_frame(txn_rows([1, 2, 3], ["client_1"]))
    two = txn_frame(txn_rows([1], ["client_2"]))
    run(snapshot(one, day(1)), clients=["client_1"])
    run(one.union(two))
    assert stored() == recomputed(one.union(two))


def test_other_clients_are_not_touched(run, stored, recomputed, txn_frame):
    txn = txn_frame(txn_rows([1, 2]))
    run(txn)
    run(txn.filter("false"), clients=["client_1"])
    kept = [r for r in recomputed(txn) if r[0] == "client_2"]
    assert [r for r in stored() if r[0] == "client_2"] == kept


def test_late_row_on_the_boundary_day(run, stored, recomputed, txn_frame):
    early = txn_rows([1, 2])
    late = [("client_1", day(2), "SKU_2", 9, 90.0, None, "94105")]
    for mode, complete in (("from", True), ("after", False)):
        run(txn_frame(early), mode=mode)
        run(txn_frame(early + late), mode=mode)
        assert (stored() == recomputed(txn_frame(early + late))) is complete
        run(txn_frame(early), mode="from")


def test_changed_mode_sees_late_corrected_and_removed_rows(run, stored, recomputed, txn_frame):
    base = txn_rows([1, 2, 3])
    run(txn_frame(base), mode="changed")
    late = base + [("client_1", day(1), "SKU_2", 9, 90.0, None, "94105")]
    result = run(txn_frame(late), mode="changed")
    assert result.days == [("client_1", day(1))]
    assert stored() == recomputed(txn_frame(late))
    corrected = [(c, d, s, q + (d == day(2)), usd, m, z) for c, d, s, q, usd, m, z in late]
    result = run(txn_frame(corrected), mode="changed")
    assert {d for _, d in result.days} == {day(2)}
    assert stored() == recomputed(txn_frame(corrected))
    removed = [r for r in corrected if r[:2] != ("client_2", day(3))]
    result = run(txn_frame(removed), mode="changed")
    assert result.cleared == [("client_2", day(3))]
    assert stored() == recomputed(txn_frame(removed))
    assert run(txn_frame(removed), mode="changed").days == []


@pytest.mark.parametrize("broadcast_days", [0, 100_000])
@pytest.mark.parametrize("mode", ["from", "changed"])
def test_undated_rows_are_left_out_and_counted(run, stored, recomputed, txn_frame, monkeypatch, mode, broadcast_days):
    """The same with few and with many changed days, in first and in later runs."""
    monkeypatch.setattr(incremental.on_days, "__defaults__", (broadcast_days,))
    dated, undated = txn_rows([1, 2]), [(CLIENTS[0], None, "SKU_1", 1, 5.0, None, "94105")]
    txn = txn_frame(dated + undated)
    assert run(txn, mode=mode).undated == 1
    assert stored() == recomputed(txn_frame(dated))
    more = txn_rows([1, 2, 3])
    assert run(txn_frame(more + undated + undated), mode=mode).undated == 2
    assert stored() == recomputed(txn_frame(more))


def test_modes_cannot_be_mixed_with_a_ledger(run, txn_frame):
    txn = txn_frame(txn_rows([1]))
    run(txn, mode="changed")
    with pytest.raises(ValueError, match="ledger"):
        run(txn)
    with pytest.raises(ValueError, match="mode"):
        run(txn, mode="strict")


def test_boundary_day_that_lost_its_rows_is_emptied(spark, root, run, stored, recomputed, txn_frame):
    run(txn_frame(txn_rows([1, 2])))
    shrunk = txn_frame(txn_rows([1]))
    result = run(shrunk)
    assert result.cleared == [(c, day(2)) for c in CLIENTS]
    assert stored() == recomputed(shrunk)
    path = states.state_path(spark, root)
    assert rows(states.high_water(states.read_state(spark, path))) == rows(states.marks(spark, path)) == [(c, day(1)) for c in CLIENTS]


def test_strict_filter_with_inclusive_delete_loses_days():
    """Why that pair of bounds is not offered: shown on plain lists."""

    def step(stored, snapshot_days):
        last = max(stored, default=None)
        new = [d for d in snapshot_days if last is None or d > last]
        kept = [d for d in stored if last is None or d < last]
        return kept + new

    stored = []
    for n in range(1, 11):
        stored = step(stored, list(range(1, n + 1)))
    assert stored == [10]
    assert step(stored, list(range(1, 11))) == []


def test_null_in_a_stored_column_fails_the_write(root, lookups, txn_frame):
    batch = states.to_state(pipeline.sales(txn_frame(txn_rows([1])), lookups, by=["client_id"]))
    with pytest.raises(Exception, match="null in stored column"):
        states.write_days(batch.withColumn("sku_group", F.lit(None).cast("string")), f"{root}/processed_sales_v1")


def test_rebuild_replaces_one_client(spark, root, run, stored, recomputed, lookups, txn_frame):
    run(txn_frame(txn_rows([1, 2, 3])))
    path = states.state_path(spark, root)
    only_two = txn_frame(txn_rows([2]))
    states.rebuild_client(states.to_state(pipeline.sales(only_two, lookups, by=["client_id"])), path, "client_1")
    expected = recomputed(txn_frame(txn_rows([2], ["client_1"]) + txn_rows([1, 2, 3], ["client_2"])))
    assert stored() == expected


def test_other_schema_starts_a_new_version(spark, root, run, stored, recomputed, txn_frame):
    old = spark.createDataFrame([("client_1", day(1), "SKU_1", 5)], "client_id string, transaction_date string, sku string, n int")
    old.write.partitionBy("client_id", "transaction_date").parquet(f"{root}/processed_sales_v1")
    txn = txn_frame(txn_rows([1]))
    assert run(txn).path.endswith("_v2")
    assert stored() == recomputed(txn)
    assert spark.read.parquet(f"{root}/processed_sales_v1").count() == 1
    assert states.state_path(spark, root).endswith("_v2")


def test_state_projection(lookups, txn_frame):
    txn = txn_frame(txn_rows([1], ["client_1"]))
    state = states.to_state(pipeline.sales(txn, lookups), "client_1")
    assert [f.dataType for f in state.schema] == [f.dataType for f in states.STATE]
    assert state.columns == states.STATE.fieldNames()
    assert {r["local"] for r in state.collect()} <= {0, 1}
    assert states.to_state(pipeline.sales(txn.filter("false"), lookups), "client_1").count() == 0


def test_last_processed_date(spark, root, run, txn_frame):
    run(txn_frame(txn_rows([1, 2])))
    state = states.read_state(spark, states.state_path(spark, root))
    assert rows(states.last_processed_date(state, "client_1")) == [(day(2),)]
    assert rows(states.last_processed_date(state, "nobody")) == [(None,)]


def test_incremental_run_reads_only_due_partitions(spark, tmp_path, lookups, txn_frame):
    landing = str(tmp_path / "landing")
    land(txn_frame(txn_rows(range(1, 8))), landing)
    since = spark.createDataFrame([("client_1", day(6)), ("client_2", day(7))], "client_id string, last_processed_date string")
    due = incremental.due_days(landed_days(spark, landing), since, inclusive=True)
    assert rows(due) == [("client_1", day(6)), ("client_1", day(7)), ("client_2", day(7))]
    source = incremental.on_days(read_landing(spark, landing), due)
    # pruned by client and by day: two of each, of two clients and seven days
    assert source.count() == 12 and partitions_read(source) == 4


def partitions_read(frame):
    """Partitions that the scans of a frame opened, by Spark's own count."""
    frame = frame.select("*")
    frame.collect()
    plan, found = frame._jdf.queryExecution().executedPlan().toString(), 0
    assert "dynamicpruning" in plan
    nodes = [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numPartitions").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return found


def test_landing_replaces_days_and_keeps_rows(spark, tmp_path, txn_frame):
    landing = str(tmp_path / "landing")
    txn = txn_frame(txn_rows([1, 2, 3]) + [("client_1", None, "SKU_1", 1, 1.0, None, "94105")])
    land(txn, landing)
    land(txn.filter(F.col("transaction_date") >= day(3)), landing)
    assert rows(read_landing(spark, landing)) == rows(txn)


def test_snapshot_rows(txn_frame):
    found = rows(snapshot_rows(txn_frame(txn_rows([1, 2, 4], ["client_1"]))))
    assert found == [("client_1", day(1), 4, 4), ("client_1", day(2), 4, 8), ("client_1", day(4), 4, 12)]


def test_late_rows_follow_the_high_water_rule(txn_frame):
    arrivals = [(1, 1), (2, 2), (1, 2), (2, 3), (3, 3), (4, 5), (5, 5)]
    txn = txn_frame([("c", day(own), "S", 1, 1.0, None, day(seen)) for own, seen in arrivals])
    found = late_rows(txn.withColumnRenamed("zip_code_raw", "arrival_day"))
    assert rows(found, "transaction_date", "arrival_day", "high_water") == [(day(1), day(2), day(1)), (day(2), day(3), day(2))]


def test_large_lookups_give_the_same_state(spark, run, stored, lookups, txn_frame, tmp_path):
    txn = txn_frame(txn_rows([1, 2]))
    run(txn)
    wide = replace(lookups, sku_small=False, zip_small=False, few_groups=False, few_categories=False)
    other = str(tmp_path / "wide")
    incremental.run_batch(spark, txn, wide, other, CLIENTS)
    assert rows(states.read_state(spark, states.state_path(spark, other))) == stored()


def test_parity_check_of_a_stored_day_warns(spark, root, run, lookups, txn_frame, caplog):
    txn = txn_frame(txn_rows([1, 2]))
    run(txn)
    state = states.read_state(spark, states.state_path(spark, root))
    assert incremental.check_day(txn, lookups, state, "client_1", day(2))
    assert not caplog.records
    other = state.withColumn("order_count", F.col("order_count") + 1)
    assert not incremental.check_day(txn, lookups, other, "client_1", day(2))
    assert "order_count_incremental" in caplog.text
    gone = state.filter("sku_group <> 'Alpha'")
    assert not incremental.check_day(txn, lookups, gone, "client_1", day(2))


def test_parity_of_all_stored_days_in_one_job(spark, root, run, lookups, txn_frame, caplog):
    txn = txn_frame(txn_rows([1, 2]))
    run(txn)
    state = states.read_state(spark, states.state_path(spark, root))
    verdicts = incremental.check_days(txn, lookups, state)
    assert rows(verdicts, "client_id", "transaction_date", "parity_pass") == [(c, day(d), True) for c in CLIENTS for d in (1, 2)]
    assert not caplog.records
    one = (F.col("client_id") == "client_2") & (F.col("transaction_date") == day(2))
    other = state.withColumn("order_count", F.col("order_count") + F.when(one, 1).otherwise(0))
    failed = incremental.check_days(txn, lookups, other).filter("not parity_pass")
    assert rows(failed, "client_id", "transaction_date") == [("client_2", day(2))]
    assert "1 stored days differ" in caplog.text and day(2) in caplog.text


def test_artifacts_of_a_run(lookups, txn_frame):
    made = pipeline.run(txn_frame(txn_rows([1, 2], ["client_1"])), lookups)
    assert made.target_date.first()[0] == day(2)
    assert made.quality.first()["rows_input"] == 8
    assert {str(r["transaction_date"]) for r in made.top_slice.collect()} == {day(2)}
    assert made.aggregated.count() > made.top_slice.count() > 0


def test_client_names_that_are_special_in_paths(spark, root, run, stored, recomputed, lookups, txn_frame):
    names = ["a:b/c=1", "50% [x]'y"]
    run(txn_frame(txn_rows([1, 2], names)), clients=names)
    one_day = txn_frame(txn_rows([1], names))
    assert run(one_day, clients=names).cleared == sorted((c, day(2)) for c in names)
    assert stored() == recomputed(one_day)
    path = states.state_path(spark, root)
    again = txn_frame(txn_rows([3], names))
    states.rebuild_client(states.to_state(pipeline.sales(again, lookups, by=["client_id"])), path, names[0])
    assert stored() == recomputed(txn_frame(txn_rows([3], names[:1]) + txn_rows([1], names[1:])))


def jobs_of(spark, work):
    """Spark jobs that a piece of work starts."""
    group = f"jobs-{id(work)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_many_emptied_days_are_one_write(spark, root, stored, run):
    """Forty clients lose four of five days at once: no write a day, and none of them on the driver."""
    txn = spark.range(200).selectExpr(
        "concat('c', id div 5) as client_id", "'T' as transaction_id", "concat('2025-10-0', 1 + id % 5) as transaction_date",
        "'SKU_1' as sku_id", "1L as quantity_sold", "1.0D as revenue_usd", "cast(null as string) as maturity_date", "'94105' as zip_code_raw",
    )
    clients = txn.select("client_id").distinct()
    run(txn, mode="changed", clients=clients)
    assert len(stored()) == 200
    results = []
    jobs = jobs_of(spark, lambda: results.append(run(txn.filter("transaction_date = '2025-10-01'"), mode="changed", clients=clients)))
    assert jobs < 40
    assert results[0].entries.filter("rows = 0").count() == 160 and results[0].days == []
    assert {r[1] for r in stored()} == {day(1)} and len(stored()) == 40
    assert {r[1] for r in rows(states.marks(spark, states.state_path(spark, root)))} == {day(1)}


def test_ten_thousand_clients_prune_partitions(spark, lookups, run, stored, tmp_path):
    """Marks are joined, not written into the filter; partitions of other days stay closed."""
    landing = str(tmp_path / "landing")
    txn = spark.range(300).selectExpr(
        "concat('c', id % 10) as client_id", "concat('T', id) as transaction_id", "concat('2025-10-0', 1 + id div 10 % 3) as transaction_date",
        "'SKU_1' as sku_id", "1L as quantity_sold", "1.0D as revenue_usd", "cast(null as string) as maturity_date", "'94105' as zip_code_raw",
    )
    land(txn, landing)
    landed, names = read_landing(spark, landing), spark.range(10_000).selectExpr("concat('c', id) as client_id")
    run(snapshot(landed, day(2)), clients=names)
    since = names.join(spark.createDataFrame([(f"c{i}", day(2)) for i in range(10)], "client_id string, last_processed_date string"), "client_id", "left")
    due = incremental.due_days(landed_days(spark, landing), since, inclusive=True)
    source = incremental.on_days(landed, due)
    assert "IN (" not in source._jdf.queryExecution().optimizedPlan().toString()
    assert source.count() == 200 and partitions_read(source) == 20
    incremental.run_batch(spark, landed, lookups, str(tmp_path / "warehouse"), names, landed=landed_days(spark, landing))
    assert {r[1] for r in stored()} == {day(1), day(2), day(3)} and len(stored()) == 30


def test_marks_open_no_state_file(spark, root, run, txn_frame):
    run(txn_frame(txn_rows([1, 2])))
    path = states.state_path(spark, root)
    files = states.marks(spark, path).inputFiles()
    assert files and all("_days/" in f for f in files)


def test_a_run_broken_off_before_its_ledger(spark, root, run, stored, recomputed, txn_frame, monkeypatch):
    """The table is ahead of the ledger: the next run redoes everything since the old mark, and
    empties what the broken run stored and the source no longer has."""
    run(txn_frame(txn_rows([1, 2])))
    path = states.state_path(spark, root)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(states.Ledger, "append", broken)
        with pytest.raises(RuntimeError):
            run(txn_frame(txn_rows([1, 2, 3, 4])))
    assert states.interrupted(spark, path)
    assert rows(states.marks(spark, path)) == [(c, day(2)) for c in CLIENTS]
    again = txn_frame(txn_rows([1, 2, 4]))
    result = run(again)
    assert result.high_water == {c: day(2) for c in CLIENTS} and result.cleared == [(c, day(3)) for c in CLIENTS]
    assert stored() == recomputed(again) and not states.interrupted(spark, path)


def test_a_table_without_a_ledger_is_counted_once(spark, root, run, stored, recomputed, txn_frame, lookups):
    """As stored before there were ledgers."""
    batch = states.to_state(pipeline.sales(txn_frame(txn_rows([1, 2])), lookups, by=["client_id"]))
    batch.write.partitionBy("client_id", "transaction_date").parquet(f"{root}/processed_sales_v1")
    txn = txn_frame(txn_rows([1, 2, 3]))
    run(txn)
    assert stored() == recomputed(txn)
    assert rows(states.marks(spark, states.state_path(spark, root))) == [(c, day(3)) for c in CLIENTS]


def test_ledger_is_compacted(spark, tmp_path, monkeypatch):
    from salesflow.plans import ledger as ledgers

    monkeypatch.setattr(ledgers, "COMPACT", 3)
    ledger = states.stored_days(spark, str(tmp_path / "t"))
    assert not ledger.exists() and ledger.read().count() == 0 and ledger.last() == 0
    for n in range(1, 9):
        ledger.append(spark.createDataFrame([("a", day(1), n), ("b", day(n), n)], "client_id string, transaction_date string, rows long"))
        assert ("a", day(1), n) in rows(ledger.read()) and ledger.read().count() == n + 1 and ledger.last() == n
    assert rows(ledger.of_batch(8)) == [("a", day(1), 8), ("b", day(8), 8)]
    assert ("a", day(1), 7) in rows(ledger.read(7))
    names = sorted(p.name for p in (tmp_path / "t_days").iterdir())
    assert names == ["all-00000003", "all-00000006", "entries-00000004", "entries-00000005", "entries-00000006", "entries-00000007", "entries-00000008"]
    # a write that did not end is as if it had not begun
    (tmp_path / "t_days" / "entries-00000009").mkdir()
    assert ledger.last() == 8 and ledger.read().count() == 9
