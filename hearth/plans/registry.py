"""The query registry: ``name -> (builder(spark, sf_dir), oracle SQL | None)``.

Every builder reads the given tables (through the derived fixtures) so its
work grows with them. Oracle SQL is DuckDB text over the same tables; the
fixture CTEs are prepended by ``with_fixtures``. Floating results are rounded
on both sides so that a value hash compares them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearth.plans.fixtures_sql import with_fixtures

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}
KINDS: dict[str, str] = {}


def register(name: str, sql: str | None = None, kind: str = "S"):
    """Decorator: add a builder (and its oracle text, if SQL can say it)."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        KINDS[name] = kind if sql is not None else "R"
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from hearth.plans import (q_clean, q_features, q_logs, q_market,  # noqa: F401
                              q_ml, q_search, q_io)
