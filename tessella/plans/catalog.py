"""The registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import rounded

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Registers a function of (spark, sf_dir); doubles of its result are rounded."""

    def add(f):
        REGISTRY[name] = (lambda spark, sf_dir: rounded(f(spark, sf_dir), digits), sql)
        return f

    return add


def _load() -> None:
    from . import cell_queries, event_queries, graph_queries, pipelines, statistics_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return REGISTRY["ranksum_dge"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracles() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
