"""Registered queries of the engine's own operators, each with SQL that another engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Operator names that each query exercises.
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None):
    """Register a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    from . import audits, decisions, evaluation, manifests, roundtrips, rules, series, signals, texts  # noqa: F401
