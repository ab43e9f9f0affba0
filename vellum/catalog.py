"""Registry of the library's queries over the driver tables and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query under ``name``, with its oracle SQL if it has one."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = query
        if oracle is not None:
            _ORACLES[name] = oracle
        return query

    return add


def queries() -> dict[str, Query]:
    """All registered queries by name."""
    import vellum.plans  # noqa: F401  registers them

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Oracle SQL by query name."""
    import vellum.plans  # noqa: F401  registers them

    return dict(_ORACLES)
