"""Queries against their SQL on the smallest tables; those with many batches are covered by test_incremental."""

import os

import pytest

from seqtide import queries
from tests.oracle import DATA, compare

#: One long sequence carries a hundredth of the smallest table's utility, and so tens of millions of its subsequences answer there.
LARGER = {n: DATA.replace("sf0.001", "sf0.01") for n in ("rhusp_static_abs", "husp_static_cust", "canonical_keys", "intuitive_format")}

SLOW = ("incremental_", "ablation_", "stream_", "evict_", "buffered_", "discovery_", "remine_", "budget_", "rhusp_flags_eucs_n", "rhusp_flags_eucs_p", "husp_minus")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", [n for n in queries.ORACLES if not n.startswith(SLOW)] + ["incremental_exact_D", "buffered_shs"])
def test_query_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], LARGER.get(name, DATA))
