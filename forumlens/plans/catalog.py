"""Registry of named queries: name -> (Spark plan builder, DuckDB oracle SQL or None)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Views, duckdb_with

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, views=(), oracle: str | None = None):
    """Register ``fn(v: Views) -> DataFrame`` under ``name``.

    ``oracle`` is SQL over the named views (added as CTEs); None marks a query
    that is checked by row count and by Python tests instead.
    """
    def deco(fn: Callable[[Views], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir))
        build.__name__ = name
        build.__doc__ = fn.__doc__
        REGISTRY[name] = (build, duckdb_with(views, oracle) if oracle else None)
        return fn
    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    from . import crawl, graph, modelling, shaping, text, web  # noqa: F401
    return REGISTRY
