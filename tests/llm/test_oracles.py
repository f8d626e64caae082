"""Registered queries against their SQL."""

from __future__ import annotations

import os

import pytest

from linkpulse.llm.queries import llm_oracles, llm_queries
from tests.oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_matches_sql(spark, name):
    assert compare(spark, connect(SF_DIR), llm_queries()[name], llm_oracles()[name], SF_DIR) == []


def test_registered():
    names = list(llm_queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
