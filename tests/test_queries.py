"""Every registered query over the signal tables against its SQL in DuckDB."""

import pytest

from signalweave.plans import registry
from tests.compare import connect, of_duckdb, of_spark

QUERIES, ORACLES = registry.queries(), registry.oracles()
#: Nothing of the smallest tables gets into these.
MAY_BE_EMPTY = {"k35_search_countries"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, small, name):
    names, rows = of_spark(QUERIES[name](spark, small))
    assert (names, rows) == of_duckdb(con, ORACLES[name])


#: Means over many rows, which the smallest tables don't have, at the scale of the driver's comparison.
LARGER = ["e1_country_hourly", "e2_country_daily", "e4_theme_hourly", "e6_theme_daily", "k1_country_heat", "k5_country_nodes", "k5_country_nodes_month", "k12_concept_from_rollup", "k13_theme_timeline", "k20_compare_periods"]


@pytest.mark.parametrize("name", LARGER)
def test_same_rows_at_a_larger_scale(spark, name):
    folder = "/root/testdata/sf0.01"
    assert of_spark(QUERIES[name](spark, folder)) == of_duckdb(connect(folder), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
