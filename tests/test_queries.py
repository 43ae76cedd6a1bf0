"""Every registered query against its SQL, over the smallest given tables."""

import compare
import pytest

from catalog.oracle import ORACLES
from catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare.differences(duck, ORACLES[name], QUERIES[name](spark, FOLDER)) == ""
