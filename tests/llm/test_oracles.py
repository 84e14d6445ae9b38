"""The operators' queries against their SQL on the smallest tables."""

import pytest
from oracle import compare

from siftmill.llm import registry


@pytest.mark.parametrize("name", ["op6_pivot_index", "op7_automaton_dedup", "op11_periodic_runs", "op13_prefix_trie"])
def test_sql(spark, sf_dir, name):
    compare(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)
