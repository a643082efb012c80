"""Registry of named queries (Spark) and their DuckDB oracle SQL.

``register(name, sql=None)`` decorates a ``(spark, sf_dir) -> DataFrame``
builder. Nested results (arrays, structs) are flattened to delimited strings
and doubles rounded to 6 places on both sides so results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
import functools

from marquee.session import ship_package

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
