"""Registered queries against their SQL, over the smallest given tables."""

import compare
import pytest

from partgraph.llm.oracle import ORACLES
from partgraph.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(llm, name):
    assert compare.differences(compare.connect(FOLDER), ORACLES[name], QUERIES[name](llm, FOLDER)) == ""
