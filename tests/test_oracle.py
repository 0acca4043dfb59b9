"""Every registered query against its SQL counterpart in DuckDB."""

import pytest
from compare import oracle_connection, oracle_rows, spark_rows
from conftest import MEDIUM, SMALL

import __spark_entry__ as contract

QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def small():
    return oracle_connection(SMALL)


def test_every_query_has_a_counterpart():
    own = {name for name in QUERIES if name != "pipeline" and not name.startswith("op")}
    assert own <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, small, name):
    names, found = spark_rows(QUERIES[name](spark, SMALL))
    expected_names, expected = oracle_rows(small, SQL[name])
    assert names == expected_names
    assert len(found) == len(expected)
    assert found == expected


def test_entry_runs(spark):
    frame = contract.entry(spark)
    assert len(frame.columns) == 14
    assert frame.count() > 0


def test_known_counts_of_the_model(spark):
    assert QUERIES["full_pipeline"](spark, MEDIUM).count() == 18_282
    assert QUERIES["multi_client_pipeline"](spark, MEDIUM).count() == 27_936
    report = QUERIES["quality_report"](spark, MEDIUM).first().asDict()
    assert report == {
        "rows_input": 60_000,
        "invalid_zip_dropped": 4_107,
        "maturity_imputed": 2_313,
        "rows_after_join": 55_893,
        "zip_lookup_miss": 1_780,
        "sku_lookup_miss": 1_399,
    }
    diff = QUERIES["parity_diff"](spark, MEDIUM).groupBy("found_in").count().collect()
    assert {r[0]: r[1] for r in diff} == {"both": 10, "baseline": 262}
    assert QUERIES["late_rows"](spark, MEDIUM).count() == 534
