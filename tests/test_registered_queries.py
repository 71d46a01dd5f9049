"""Every registered query against its SQL, and the entry points themselves."""

import pytest

import __spark_entry__ as contract
from gridcast.plans import oracle, registered
from tests.oracle_check import compare, views

SF = "/root/testdata/sf0.01"
# Solvers and training: compared with brute force in the other tests.
ROWS_ONLY = {"adf_test", "adf_test_own_lags", "arma_fit", "arma_order_search", "arma_order_search_configured", "latent_fit", "sequence_forecast",
             "sequence_fit", "arma_day_forecast", "compressed_day_forecast"}


@pytest.fixture(scope="module")
def con():
    return views(SF)


def test_every_query_is_checked():
    assert set(registered.QUERIES) == set(oracle.SQL) | ROWS_ONLY
    assert set(registered.QUERIES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == ["cell_a", "cell_b", "r", "n"]
    assert contract.entry(spark).count() == 4


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query(spark, con, name):
    verdict, rows = compare(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name])
    assert verdict.startswith("ok") and rows > 0, verdict


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_gives_rows(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0
