"""Registered analytic queries over the benchmark tables.

Each entry maps one operator family onto the tables (item = part or event
type, quantity = l_quantity, price = l_extendedprice / events.value,
customer = o_custkey, date = o_orderdate, segment = c_mktsegment, tenant =
nation or user) and comes with an equivalent SQL text where SQL can say the
same thing.  Spark and SQL alias every output column identically.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def _load() -> None:
    # Importing the modules registers their queries.
    from mercato.catalog import (  # noqa: F401
        q_series, q_insights, q_cleaning, q_runs, q_churn, q_models, q_demand, q_stream,
        q_null_groups, q_uploads, q_tenants, q_sinks,
    )


_load()
