"""Queries of this subpackage that SQL can express."""

import pytest

from mailweave.llm import registry
from tools.compare import compare, connect


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    assert not compare(registry.queries()[name](spark, sf), connect(sf), registry.oracle_sql()[name])


def test_all_queries():
    assert [q.split("_")[0] for q in registry.queries()] == [f"op{n}" for n in range(1, 14)]
