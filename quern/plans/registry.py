"""Registered queries: a callable of (spark, sf_dir), and SQL for the oracle where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.sources.graph import BRIDGE_SQL, Graph, bridge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir)."""

    def keep(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def on_graph(name: str, f: Callable[[Graph], DataFrame], sql: str | None = None) -> None:
    """Registers a function of the evidence graph; sql follows the bridge's common table expressions."""
    query(name, f"{BRIDGE_SQL.rstrip()},\n{sql}" if sql and sql.lstrip().startswith("q_") else f"{BRIDGE_SQL}{sql}" if sql else None)(lambda spark, sf_dir: f(bridge(spark, sf_dir)))
