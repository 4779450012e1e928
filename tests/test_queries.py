"""Every query with a DuckDB equivalent gives the same rows, and every query runs."""

from __future__ import annotations

import os

import pytest

from millrace.plans import registry
from tests.oracle import database, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
#: Their inputs are so small here that nothing is left.
MAY_BE_EMPTY = {"s02_paged_scan", "g11_obsolete_breadcrumbs", "k27_refused_questions", "n01_planar_distance", "r25_unknown_zones"}


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(spark, con, name):
    said = difference(spark, con, registry.QUERIES[name], registry.ORACLES[name], SF)
    assert said == "" or (said == "no rows" and name in MAY_BE_EMPTY), said


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert registry.flagship(spark, SF).columns == ["query_id", "doc_id", "vector_score", "lexical_score", "score", "rank"]
