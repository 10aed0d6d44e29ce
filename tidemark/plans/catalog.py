"""Every query of the core library, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import case_queries, evidence_queries, pipelines, posterior_queries, raster_queries, track_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (track_queries, evidence_queries, posterior_queries, raster_queries, case_queries, pipelines):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
