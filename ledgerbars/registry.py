"""Name -> query and, where SQL can express it, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Modules whose import registers queries.
MODULES = ("bars", "joins", "aggregates", "windows", "calendars", "money", "state", "text", "rules", "limits", "control", "ledger", "feeds", "sets", "sourcing", "surfaces")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its own name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _load() -> None:
    for m in MODULES:
        import_module(f"ledgerbars.plans.{m}")
    import_module("ledgerbars.streaming.queries")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
