"""Helpers for higher-order functions.

Catalyst inlines a projected column into every lambda that reads it
(CollapseProject), so ``transform(a, (x, i) -> get(b, i))`` re-evaluates the
whole expression behind ``b`` for every element: quadratic per row.  ``let``
evaluates a value once and binds it to a lambda variable, so lambdas that do
random access into derived arrays stay linear.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(v)`` with ``v`` = ``value`` evaluated once (``transform(array(value), body)[0]``)."""
    return F.get(F.transform(F.array(value), body), 0)


def let_many(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Bind several values at once; ``body`` receives a struct with the given field names."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def bind_column(df, name: str, value: Column):
    """Add ``name`` = ``value`` computed once per row, even when later steps read it several times.

    A one-element ``explode`` makes the value a generator output (an
    attribute), which Catalyst cannot inline back into each consumer.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def shift_right(a: Column, fill) -> Column:
    """``[fill, a0, a1, …, a(n-2)]`` aligned with ``a`` (previous element at each position)."""
    return F.concat(F.array(F.lit(fill) if not isinstance(fill, Column) else fill), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))


def shift_left(a: Column, fill) -> Column:
    """``[a1, …, a(n-1), fill]`` aligned with ``a`` (next element at each position)."""
    return F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))),
                    F.array(F.lit(fill) if not isinstance(fill, Column) else fill))
