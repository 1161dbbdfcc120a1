"""Every registered query next to its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests import oracle

# Nothing to find at this scale; the larger tables have rows.
MAY_BE_EMPTY = {"a11_untagged_failures", "d12_mine_patterns"}


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == [
        "run_id", "root_cause_step_index", "root_cause_error_type", "root_cause_source"
    ]
    assert frame.count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, con, name):
    build, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert name in MAY_BE_EMPTY or build(spark, sf).count() > 0
        return
    problem = oracle.compare(spark, con, name, build, sql, sf)
    if name in MAY_BE_EMPTY and problem == "both empty":
        problem = None
    assert problem is None, problem
