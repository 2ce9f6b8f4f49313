"""Every query of the library by name, with its DuckDB counterpart.

A plan module registers a query with @query("name", fixtures, sql): the function gets its fixtures as
DataFrames, and the SQL says the same over the same relations.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from cairn.plans.fixtures import fixture, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, doc: str | None, needs: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    run.__name__, run.__doc__ = name, doc
    if name in QUERIES:
        raise ValueError(f"two queries are named {name}")
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = with_fixtures(needs, sql)


def query(name: str, needs: str, sql: str | None = None):
    def register(build: Callable[..., DataFrame]):
        _register(name, build.__doc__, needs, sql, lambda spark, sf_dir: build(*[fixture(spark, sf_dir, n) for n in needs.split()]))
        return build

    return register


def stream_query(name: str, table: str, sql: str | None = None):
    """A query whose function gets an input table as a stream."""
    from cairn.streaming.spans import read_stream

    def register(build: Callable[[DataFrame], DataFrame]):
        _register(name, build.__doc__, table, sql, lambda spark, sf_dir: build(read_stream(spark, sf_dir, table)))
        return build

    return register


for _module in ("relational", "statistics", "policy", "code_metrics", "code_graph", "memory", "sources", "streams"):
    import_module(f"cairn.plans.{_module}")
