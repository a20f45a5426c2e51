"""Generic row operators.

Transforms are ``DataFrame -> DataFrame`` functions.  Returned columns are
merged into the row (``withColumns``), never projected, so later steps can still
read the columns a rekey replaced.
"""

from __future__ import annotations

import functools
import inspect
from typing import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of the rows that ``map_batches`` hands over at once.
BATCH_BYTES = 1 << 21


def map_rows(fn: Callable[[DataFrame], dict[str, Column]]):
    """B1: decorator; ``fn`` returns ``{name: Column}`` merged into the row."""

    @functools.wraps(fn)
    def run(df: DataFrame, **kw) -> DataFrame:
        return df.withColumns(fn(df, **kw) if _wants(fn, "df") else fn(**kw))

    return run


def _wants(fn, name: str) -> bool:
    try:
        return name in inspect.signature(fn).parameters
    except (TypeError, ValueError):
        return False


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema,
                remove_columns: Iterable[str] = (), batch_size: int | None = None) -> DataFrame:
    """``fn`` gets a pandas batch and may return any number of rows.

    ``batch_size`` is the most rows that ``fn`` gets at once (batches are cut
    inside the task, so no session setting changes), without it as many as hold
    ``BATCH_BYTES``; ``remove_columns`` are dropped before the batches are built
    (so they never cross into Python).
    """
    src = df.drop(*remove_columns)

    def it(batches):
        for b in batches:
            size = batch_size or max(1, len(b) * BATCH_BYTES // max(1, int(b.memory_usage(index=False, deep=True).sum())))
            for at in range(0, len(b), size):
                out = fn(b.iloc[at:at + size] if batch_size else b.iloc[at:at + size].reset_index(drop=True))
                if out is not None and len(out):
                    yield out

    return src.mapInPandas(it, schema)


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """A real filter (rows failing the predicate are dropped)."""
    return df.where(predicate)


def rekey(df: DataFrame, key_map: dict[str, str | None] | None) -> DataFrame:
    """``{new: old}``; ``old`` empty or None gives ``''``; empty map is identity.

    All new values are read from the input row, so swaps are safe.
    """
    if not key_map:
        return df
    cols = {new: (F.col(f"`{old}`") if old else F.lit("")) for new, old in key_map.items()}
    return df.withColumns(cols)


def chain(df: DataFrame, steps: Iterable[Callable], **context) -> DataFrame:
    """Apply each step in order; a step gets only the context arguments it names."""
    for step in steps:
        params = inspect.signature(step).parameters
        kw = {k: v for k, v in context.items() if k in params}
        df = step(df, **kw)
    return df
