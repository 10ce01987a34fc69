"""All registered queries of the telemetry operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from icuflow.plans import chains, changes, decisions, exchange, features, live, sinks, stays, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**features.QUERIES, **decisions.QUERIES, **live.QUERIES, **changes.QUERIES, **exchange.QUERIES, **streams.QUERIES, **stays.QUERIES, **chains.QUERIES, **sinks.QUERIES}
ORACLE_SQL: dict[str, str] = {**features.ORACLE_SQL, **decisions.ORACLE_SQL, **live.ORACLE_SQL, **changes.ORACLE_SQL, **exchange.ORACLE_SQL, **streams.ORACLE_SQL, **stays.ORACLE_SQL, **chains.ORACLE_SQL, **sinks.ORACLE_SQL}
