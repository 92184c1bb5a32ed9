"""Registered queries: name -> (spark callable, oracle SQL or None).

Each callable takes (spark, sf_dir) and returns a DataFrame over the driver's
tables.  The oracle is DuckDB SQL over the same tables (pre-registered views)
giving the same columns; it is omitted where the result depends on a model
fit or a streaming run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _load() -> None:
    from flowlens.plans.catalog import (  # noqa: F401
        cleaning, detection, evaluation, labels, model, profile, sampling, sources, streaming,
    )


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
