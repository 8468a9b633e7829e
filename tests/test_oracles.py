"""Every registered query of the engine against its SQL, and the entry point."""

from __future__ import annotations

import pytest

from chronosweep.plans import catalogue, live_catalogue, stored_catalogue, sweep_catalogue
from tests.conftest import MIDDLE, SMALL, same_as_oracle

assert live_catalogue and stored_catalogue and sweep_catalogue  # they register their queries with the catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    same_as_oracle(catalogue.QUERIES[name](spark, MIDDLE), catalogue.ORACLES[name], MIDDLE)


@pytest.mark.parametrize("name", ["tick_to_m1", "library_signals", "metrics_core", "sim_full", "classify"])
def test_query_equals_sql_on_few_rows(spark, name):
    same_as_oracle(catalogue.QUERIES[name](spark, SMALL), catalogue.ORACLES[name])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"pair", "direction", "n", "mean_price"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
