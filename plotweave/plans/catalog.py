"""Every published query with its DuckDB equivalent, collected from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotweave.plans import layout_queries, literal_queries, record_queries, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (records, record_queries, layout_queries, literal_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
