"""Registry of the queries: name -> Spark callable, and name -> SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    if name in _queries:
        raise ValueError(f"{name} is registered twice")
    _queries[name] = query
    if oracle is not None:
        _oracles[name] = oracle


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
