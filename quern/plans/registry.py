"""Every query of the engine with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` gives the same rows in DuckDB."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return add


def _load() -> None:
    import importlib
    import pkgutil

    from quern import plans

    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"quern.plans.{m.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["r3_bm25_topk"](spark, sf_dir)
