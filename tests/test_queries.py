"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from check import duck, rows

from webframe.plans.oracles import ORACLES
from webframe.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    got = entry_points.entry(spark)
    assert got.columns == ["host", "n_pages", "n_links"] and got.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
