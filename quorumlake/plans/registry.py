"""Registered queries: each a function of the civic layer, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorumlake.model import CIVIC_SQL, Civic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_civic_layer(sql: str, recursive: bool = False) -> str:
    """sql after the civic layer's common table expressions; a leading comma adds expressions of its own, which may be
    recursive."""
    head = "WITH " + "RECURSIVE " * recursive + ", ".join(f"{name} AS ({body})" for name, body in CIVIC_SQL.items())
    return head + (sql if sql.lstrip().startswith(",") else " " + sql)


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register a function of the civic layer as a query."""

    def register(f: Callable[[Civic], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Civic(spark, sf_dir))
        if sql:
            ORACLES[name] = with_civic_layer(sql, recursive)
        return f

    return register


#: Readers that are operators under another name.
ALIASES: dict[str, str] = {}


def alias(name: str, operator: str) -> None:
    """Register an operator under a reader's name, once all are known."""
    ALIASES[name] = operator


def add_aliases() -> None:
    for name, operator in ALIASES.items():
        QUERIES[name] = QUERIES[operator]
        if operator in ORACLES:
            ORACLES[name] = ORACLES[operator]
