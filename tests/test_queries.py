"""Every registered query against its SQL twin, and the shape of some plans."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from linkpulse.plans.oracles import oracles
from linkpulse.plans.queries import all_queries
from tests.oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = all_queries(), oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_twin_has_a_query():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], SF_DIR) == []


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_entry_registers_all():
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_scans_read_only_what_they_need(spark):
    text = plan(spark, "sample_counts")
    assert "ReadSchema: struct<user_id:bigint>" in text
    assert "GreaterThan(ts," in plan(spark, "stats_window").replace("GreaterThanOrEqual", "GreaterThan")


def test_newest_rows_need_no_full_sort(spark):
    text = plan(spark, "latest_n")
    assert "TakeOrderedAndProject" in text


def test_ranks_are_cut_before_the_shuffle(spark):
    assert "Partial" in plan(spark, "history_per_router")


def test_no_cross_products(spark):
    for name in QUERIES:
        text = plan(spark, name)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
