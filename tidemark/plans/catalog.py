"""All queries over the relational and telemetry tables, by name, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, forms, outcomes, policies, streams, telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = telemetry.QUERIES | policies.QUERIES | outcomes.QUERIES | forms.QUERIES | files.QUERIES | streams.QUERIES
ORACLE_SQL: dict[str, str] = telemetry.SQL | policies.SQL | outcomes.SQL | forms.SQL | files.SQL | streams.SQL
FLAGSHIP = "cycle_summary"
