"""All registered queries of the raster-tile operators, with the DuckDB statement that each must equal."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
MODULES = ("tile_queries", "history_queries", "space_queries", "stream_queries", "file_queries")


def register(name: str, sql: str | None = None):
    """Registers a query callable (spark, sf_dir) -> DataFrame under ``name``."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _load() -> None:
    import importlib

    for module in MODULES:
        importlib.import_module(f"tilewright.plans.{module}")


def queries() -> dict[str, Callable]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLE
