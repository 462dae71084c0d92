"""Every catalogue query against its DuckDB twin (the driver's correctness gate), on sf0.001."""

import pytest

import __spark_entry__ as entry_mod
from tests.compare import compare, duck
from tests.conftest import SF_SMALL

QUERIES = entry_mod.queries()
ORACLES = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["short_code", "country", "country_code", "total_clicks", "percentage"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    ok, rows, detail = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert ok, detail


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
