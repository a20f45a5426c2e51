"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame`` plus the DuckDB oracle SQL."""

from __future__ import annotations

from typing import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco
