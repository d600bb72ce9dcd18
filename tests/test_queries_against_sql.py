"""Every registered query against its SQL on the small tables."""

import pytest

from check_oracle import compare, connect
from verdikt.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(con, SQL[name], QUERIES[name](spark, FOLDER)) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() > 0
