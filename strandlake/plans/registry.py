"""All queries of the engine's own operators and their SQL.

Modules register with :func:`query`; identifiers in the docstrings are those of
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Module of each query.
MODULES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under a name, with its SQL if SQL can express it."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name], MODULES[name] = run, fn.__module__
        if sql:
            ORACLES[name] = sql
        return fn

    return add


from . import bridge_queries, cn_queries, format_queries, interval_queries, sequence_queries, source_queries, table_queries  # noqa: E402, F401
