"""Every registered query against its SQL, at the smallest scale."""

import pytest

from __spark_entry__ import entry
from fleetlens.plans.oracles import ORACLES
from fleetlens.plans.queries import QUERIES
from tests.compare import compare, engine


@pytest.fixture(scope="module")
def con(small):
    return engine(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal(name, spark, con, small):
    assert compare(spark, con, small, name, QUERIES[name], ORACLES[name]) is None
