"""Every registered query against its SQL counterpart, on whole tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
import duckdb_checks
import duckdb_learned

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


OWN = {**duckdb_checks.statements(), **duckdb_learned.statements()}


def test_every_query_has_sql():
    registered = set(entry.queries())
    others = set(entry.llm.queries()) | {"pipeline"} if entry.llm else set()
    assert registered - others == set(OWN)
    assert set(entry.oracle_sql()) <= registered


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), con, OWN[name]) == ""


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["left", "right", "count"]
    assert df.count() == 200
