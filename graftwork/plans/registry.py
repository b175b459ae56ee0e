"""Queries and their SQL checks, registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graftwork.plans.bindings import bind, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FUNCTIONS: dict[str, Callable[..., DataFrame]] = {}


def query(name: str, *bindings: str, sql: str | None):
    """Register ``fn(*bound tables)`` under ``name`` with its SQL text."""

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(*[bind(spark, sf_dir, b) for b in bindings])
        FUNCTIONS[name] = fn
        if sql is not None:
            ORACLES[name] = with_bindings(list(bindings), sql)
        return fn

    return wrap
