"""All queries of the core engine and the SQL that states each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Modules that register queries when they are imported.
MODULES = ("docproof.plans.text_queries", "docproof.plans.link_queries", "docproof.plans.verdict_queries", "docproof.plans.audit_queries")


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = query
        if oracle:
            _ORACLES[name] = oracle
        return query

    return add


def _load() -> None:
    from importlib import import_module

    for module in MODULES:
        import_module(module)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
