"""The registry of queries: each is a function of a session and a folder of tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, derived: bool = False) -> Callable[[Query], Query]:
    """Register a query by its function's name; derived: its SQL stands on the fixture's tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            if derived:
                again = "RECURSIVE " if body.startswith("WITH RECURSIVE ") else ""
                rest = body.removeprefix("WITH ").removeprefix(again)
                body = f"WITH {again}{fixture.SQL.strip()}{', ' + rest if body.startswith('WITH ') else ' ' + body}"
            ORACLES[f.__name__] = body
        return f

    return add
