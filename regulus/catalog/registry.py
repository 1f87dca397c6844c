"""Registry that pairs each Spark query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from regulus.sources.fixtures import Tables, with_views


@dataclass(frozen=True)
class Query:
    key: str
    survey: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(key: str, survey: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``build(tables)`` under ``key``; ``views`` are put in front of ``sql`` as CTEs."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in REGISTRY:
            raise ValueError(f"duplicate query {key}")
        text = None if sql is None else (with_views(sql, *views) if views else sql.strip())
        REGISTRY[key] = Query(key, survey, build, text)
        return build

    return add


def rd(col, digits: int = 6):
    """Round for comparison; adding 0.0 turns a negative zero into zero."""
    from pyspark.sql import functions as F
    return F.round(col, digits) + F.lit(0.0)
