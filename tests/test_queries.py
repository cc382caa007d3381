import pytest

from tests.oracle import SF, assert_same, connect
from tidemark.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_admission_reaches_the_scan_and_columns_are_pruned(spark):
    plan = QUERIES["asof_admission"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "o_orderdate" in plan


def leaves(df):
    """What an optimised plan reads; kept cells were read into memory once, however often they are used."""
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [found.apply(i).nodeName() for i in range(found.size())]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_table_is_read_twice(spark, name):
    spark.catalog.clearCache()
    tables = {"via_join_cells": 2, "via_guard": 2, "via_ambiguous": 3, "parity_months": 2}  # a lookup, a second side
    found = leaves(QUERIES[name](spark, SF))
    assert found.count("LogicalRelation") <= (tables.get(name, 1) if "InMemoryRelation" not in found else 0)
    spark.catalog.clearCache()


def test_grouping_sets_scan_once_with_one_exchange(spark):
    spark.catalog.clearCache()
    plan = QUERIES["canonical_grouping_sets"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["via_join_cells", "via_guard", "via_ambiguous", "parity_months"])
def test_no_order_is_filtered_by_its_key(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "o_orderkey" in x and "atleastnnonnulls" not in x]


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
