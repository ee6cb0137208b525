"""Registry of the named queries (one per operator group of the inventory)
and their DuckDB oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame`` that reads the
driver's tables, shapes a stand-in input (``plans.inputs``) and runs the
library's operators over all of it.  The oracle, when the operator is
expressible in SQL, computes the same result from the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

MODULES = ["q_cleaning", "q_weather", "q_lookup", "q_scoring", "q_reply", "q_model", "q_io", "q_stream"]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register a query under ``name`` with an optional oracle."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_str(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def load_all() -> None:
    """Import every query module so the registry is complete."""
    import importlib

    for mod in MODULES:
        importlib.import_module(f"wearcast.plans.{mod}")
