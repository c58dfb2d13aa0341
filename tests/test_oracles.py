"""Every registered query against its SQL oracle on the smallest given tables."""

import pytest

import checking
from catalog.oracles import ORACLES
from catalog.queries import QUERIES


@pytest.fixture(scope="module")
def con(small):
    return checking.connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    assert checking.difference(df, con, ORACLES[name]) is None


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
