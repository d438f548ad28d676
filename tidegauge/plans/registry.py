"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


def map_text(column: str) -> Column:
    """A map as ``key=value`` pairs in key order."""
    return F.array_join(
        F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ","
    ).alias(column)
