"""The queries that SQL can state, against SQL on whole tables."""

import pytest
from compare import compare, connect
from llm_tables import SMALL

from verbaloom.llm import registry


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_one_query_for_each_operator():
    numbers = [int(name.split("_")[0].removeprefix("op")) for name in registry.queries()]
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(registry.queries()[name](spark, SMALL), con, registry.oracle_sql()[name]) == ""
