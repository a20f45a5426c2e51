"""Arrow batches in steps of bounded size.

Spark cuts batches by rows and by the bytes of their input; what a step makes of a row (tokens, windows, marked
copies) is many times that. These helpers hand a step a few rows at a time, so a task holds what those make.
"""

from __future__ import annotations

from typing import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of the rows, or characters of the texts, that one step gets; a larger one comes alone.
STEP = 1 << 18


def steps(columns: tuple[pa.Array, ...]) -> Iterator[list[pa.Array]]:
    """The rows of a batch in order, in slices of ``STEP`` bytes at most or of one row."""
    todo = [(0, len(columns[0]))]
    while todo:
        a, b = todo.pop()
        part = [c.slice(a, b - a) for c in columns]
        if b - a > 1 and sum(c.nbytes for c in part) > STEP:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        else:
            yield part


def stepwise(fn: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``fn`` of a whole batch, made in steps: for results that are not much larger than the batch."""
    parts = [fn(*part) for part in steps(columns)]
    return pa.concat_arrays(parts) if len(parts) > 1 else parts[0]


def fan_out(fn: Callable[..., pa.Array], ddl: str, *columns: Column) -> Column:
    """``fn`` as an Arrow function whose steps leave the task one by one: for results that are much larger than their rows."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in steps(batch if isinstance(batch, tuple) else (batch,)):
                yield fn(*part)

    return F.arrow_udf(run, ddl)(*columns)


def groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in order, in lists of about ``STEP`` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= STEP:
            yield held
            held, size = [], 0
    if held:
        yield held
