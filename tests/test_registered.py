"""Registered queries beside their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import compare
from checks.derived import BASE

# Model queries need more events than the smallest scale has: there whole
# groups have none among the exposed, and estimates run off to infinity.
DATA_QUERIES = [
    name
    for name in registry.ORACLES
    if not name.startswith(
        ("poisson", "nb_", "profile", "sequential", "pearson", "adjustment", "aic", "mixed", "collapsed", "year_")
    )
]


def connect(sf_dir):
    c = duckdb.connect()
    for table in BASE:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return c


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_entry(spark):
    assert entry.entry(spark).columns == ["quintile", "persons", "attends", "prop", "lcl", "ucl"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", DATA_QUERIES)
def test_matches_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, sf_dir, name)
    assert ok, note


@pytest.mark.parametrize(
    "name",
    [
        "poisson_adjusted_error", "nb_adjusted", "profile_limits", "adjustment_comparison", "mixed_intercept_poisson_season",
        "mixed_intercept_nb", "mixed_intercept_gaussian", "collapsed_nb_admits", "year_nb_borough", "nb_absorbed_practice",
    ],
)
def test_models_match_sql(spark, name):
    larger = "/root/testdata/sf0.01"
    ok, note = compare(spark, connect(larger), larger, name)
    assert ok, note
