"""Queries of the subpackage that SQL can express give DuckDB's rows."""

from __future__ import annotations

import os

import pytest

from millrace.llm import registry
from tests.oracle import database, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(spark, name):
    assert difference(spark, database(SF), registry.QUERIES[name], registry.ORACLES[name], SF) in ("", "no rows")
