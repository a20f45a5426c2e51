"""Batch scoring with a user model (V1/U6): inputs chosen by name, a named method, keyword filtering, generate mode.

The model is an object that ``load`` builds once per Python worker.  Rows reach one of its methods as Arrow batches of
at most ``batch_rows``: the chosen input columns and the constants become keyword arguments, those that the method's
signature does not name are left out, and the result becomes the prediction column.
"""

from __future__ import annotations

import inspect
import operator
import uuid
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Models of this worker by the key of their plan.
_MODELS: dict[str, object] = {}


def _model(key: str, load: Callable[[], object]) -> object:
    if key not in _MODELS:
        _MODELS[key] = load()
    return _MODELS[key]


def named_arguments(method: Callable, values: dict) -> dict:
    """The values whose names stand in the method's signature."""
    names = inspect.signature(method).parameters
    return {k: v for k, v in values.items() if k in names}


def to_input(col: pa.Array):
    """A column of a batch as the model sees it: numbers as an array, sequences of one length as a matrix (of any
    depth), ragged sequences as a list of arrays, anything else (strings, structs, columns with nulls) as a list."""
    t = col.type
    if pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        values = to_input(col.flatten()) if not col.null_count else None
        if values is None or len(col) == 0:
            return col.to_pylist()
        sizes = [len(x) for x in col] if pa.types.is_fixed_size_list(t) else col.value_lengths().to_pylist()
        if len(set(sizes)) == 1 and isinstance(values, np.ndarray):
            return values.reshape(len(col), sizes[0], *values.shape[1:])
        at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return [values[a:b] for a, b in zip(at, at[1:])]
    if (pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_boolean(t)) and not col.null_count:
        return col.to_numpy(zero_copy_only=False)
    return col.to_pylist()


def first_output(result):
    """The result itself if it is one array, else its first part (a tuple of logits and more, an output object)."""
    if isinstance(result, (np.ndarray, list)):
        return result
    if isinstance(result, dict):
        return next(iter(result.values()))
    return result[0]


def score_batches(df: DataFrame, load: Callable[[], object], inputs: list[str], method: str = "forward", constants: dict | None = None,
                  logit_to_id: bool = True, out: str = "predictions", out_type: str | T.DataType = "int", keep: list[str] | None = None,
                  batch_rows: int = 1024) -> DataFrame:
    """``df`` with the predictions of ``load()``'s ``method``.

    ``inputs`` names the columns given to the model (those that ``df`` lacks are passed over, as keywords that the
    method does not take are); ``constants`` adds keyword arguments and wins over columns.  Only ``forward`` turns
    logits into ids (the first greatest entry along the last axis, where ``logit_to_id``); ``generate`` and any other
    method give their result as it is, or its first part.  ``method`` may be dotted (``encoder.encode``).  ``out_type``
    is the prediction's type (``int``, ``array<int>``, ``array<double>``, …).  ``keep`` are the columns passed
    through (all but ``out`` by default).  One row out per row in, in place: no shuffle.  A method that gives another
    number of rows than its batch raises ``ValueError``.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    used = [c for c in inputs if c in df.columns]
    kind = T.DataType.fromDDL(out_type) if isinstance(out_type, str) else out_type
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, kind)])
    arrow, key, fixed = to_arrow_type(kind), uuid.uuid4().hex, dict(constants or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = operator.attrgetter(method)(_model(key, load))
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                values = {c: to_input(batch.column(len(keep) + i)) for i, c in enumerate(used)}
                result = first_output(call(**named_arguments(call, {**values, **fixed})))
                if method == "forward" and logit_to_id:
                    result = np.asarray(result).argmax(axis=-1)
                if len(result) != batch.num_rows:
                    raise ValueError(f"{method} gave {len(result)} rows for a batch of {batch.num_rows}")
                column = pa.array(list(result) if getattr(result, "ndim", 1) == 1 else [x.tolist() for x in result], arrow)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), column], names=[*keep, out])

    return df.select(*keep, *used).mapInArrow(run, schema)


class BagModel:
    """A small model over token ids, for tests and queries: each id votes for every class with a fixed weight.

    ``forward`` gives logits (and the number of tokens read), ``generate`` the ids of the tokens whose vote for the
    strongest class is positive, the first ``max_length`` of them.
    """

    def __init__(self, classes: int = 7, step: int = 1):
        self.classes, self.step = classes, step

    def votes(self, ids: np.ndarray) -> np.ndarray:
        return (ids[..., None] * (6 + self.step) + np.arange(self.classes) * 3) % 11 - 5

    def forward(self, input_ids: np.ndarray, attention_mask: np.ndarray, scale: float = 1.0):
        ids, mask = np.asarray(input_ids, np.int64), np.asarray(attention_mask, np.int64)
        return (self.votes(ids) * mask[..., None]).sum(axis=1) * scale, mask.sum(axis=1)

    def generate(self, input_ids: np.ndarray, attention_mask: np.ndarray, max_length: int = 8):
        ids, mask = np.asarray(input_ids, np.int64), np.asarray(attention_mask, np.int64)
        best = (self.votes(ids) * mask[..., None]).sum(axis=1).argmax(axis=1)
        chosen = (np.take_along_axis(self.votes(ids), best[:, None, None], axis=2)[..., 0] > 0) & (mask > 0)
        return [row[c][:max_length] for row, c in zip(ids, chosen)]
