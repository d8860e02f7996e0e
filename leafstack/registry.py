"""Every query of the library by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Modules that register queries when they are imported.
MODULES: tuple[str, ...] = ("leafstack.plans.listing", "leafstack.plans.trees", "leafstack.plans.scalars", "leafstack.plans.archives", "leafstack.plans.readers")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register f(spark, sf_dir) under name."""

    def put(f: Query) -> Query:
        if name in _QUERIES and _QUERIES[name].__qualname__ != f.__qualname__:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return put


def _load() -> None:
    import importlib

    for module in MODULES:
        importlib.import_module(module)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
