"""Queries that SQL can express against their SQL."""

import os

import pytest

from seqtide.llm import queries
from tests.oracle import DATA, compare


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])
