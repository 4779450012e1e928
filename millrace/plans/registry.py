"""All registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import advice, chunks, entities, feeds, graph, lookups, more, orders, records, relational, retrieval, route_plans, routing, search, services, stores  # noqa: F401
from millrace.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid(spark, sf_dir)
