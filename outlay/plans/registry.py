"""The registered queries: name -> query, and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from outlay.plans.crosswalk import CONTRACTS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str) -> Callable[[Query], Query]:
    """Adds a query under its function's name; sql may use the table `contracts`."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {CONTRACTS_SQL}{sql}" if sql.startswith(",") else f"WITH {CONTRACTS_SQL} {sql}" if " contracts" in sql and not sql.startswith("WITH ") else sql
        return f

    return add
