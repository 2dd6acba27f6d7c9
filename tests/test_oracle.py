"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Fitting takes its time; test_models.py looks at these on small frames.
FITTED = {
    "train_delay_classifier", "tune_random_search", "score_delay", "persist_model",
    "train_rfm_clusters", "train_revenue_model", "train_units_model", "forecast_next_week",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, duck, sf_dir):
    _, problem = compare(spark, duck, QUERIES[name], ORACLES[name], sf_dir)
    assert not problem, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - FITTED))
def test_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
