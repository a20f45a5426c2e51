"""Declarative task specs and the task registry.

A task is a source, an ordered chain of ``DataFrame -> DataFrame`` steps, the
output features (with their tokenizer and EOS flag), a post-processing step
for predictions, metric functions and a best-so-far selector.  ``prepare``
builds one lazy plan; nothing runs until the caller asks for an action.
"""

from __future__ import annotations

import inspect
import re
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"^[\w\d\.\:_]+$")


@dataclass(frozen=True)
class FeatureSpec:
    """An output feature: tokenizer and whether EOS is appended (``required``/``dtype`` are informative)."""

    tokenizer: object
    add_eos: bool = True
    required: bool = True
    dtype: str = "int32"


@dataclass(frozen=True)
class TaskSpec:
    name: str
    source: Callable[[SparkSession, str], DataFrame]
    steps: tuple = ()
    output_features: dict = field(default_factory=dict)
    postprocess: Callable[[DataFrame], DataFrame] | None = None
    metrics: tuple = ()
    best: Callable[[DataFrame], DataFrame] | None = None
    model_columns: tuple = ("input_ids", "attention_mask", "labels")

    def features(self) -> dict:
        """Output features sorted by name."""
        return dict(sorted(self.output_features.items()))

    def prepare(self, spark: SparkSession, root: str, sequence_length: dict | None = None,
                all_columns: bool = False) -> DataFrame:
        """Source → chain (each step gets ``sequence_length``/``output_features`` only if it names them)."""
        return self.apply(self.source(spark, root), sequence_length, all_columns)

    def apply(self, df: DataFrame, sequence_length: dict | None = None, all_columns: bool = False) -> DataFrame:
        """The chain over a given source table or stream."""
        ctx = {"sequence_length": sequence_length, "output_features": self.features()}
        for step in self.steps:
            params = inspect.signature(step).parameters
            df = step(df, **{k: v for k, v in ctx.items() if k in params})
        if all_columns:
            return df
        return df.select(*[c for c in self.model_columns if c in df.columns])

    def score(self, scored: DataFrame, words=None) -> DataFrame:
        """Post-process predictions, then union every metric's ``(metric, score, count)`` rows.

        ``words`` (``TableVocab.word_list``) goes to post-processing steps that decode; a metric may return
        None where the rows lack its columns.
        """
        df = scored
        if self.postprocess:
            takes_words = "words" in inspect.signature(self.postprocess).parameters
            df = self.postprocess(df, words=words) if takes_words else self.postprocess(df)
        out = None
        for m in self.metrics:
            r = m(df)
            if r is not None:
                out = r if out is None else out.unionByName(r)
        return out

    def mark_best(self, history: DataFrame, **kw) -> DataFrame:
        """The selector of the task over its ``(task, metric, step, score)`` history."""
        return self.best(history, **kw) if self.best else history


class TaskRegistry:
    """Name → task; names must match ``^[\\w\\d\\.\\:_]+$`` and may not repeat."""

    _tasks: dict[str, TaskSpec] = {}

    @classmethod
    def add(cls, task: TaskSpec) -> TaskSpec:
        if not _NAME.match(task.name):
            raise ValueError(f"invalid task name {task.name!r}")
        if task.name in cls._tasks:
            raise ValueError(f"task {task.name!r} already registered")
        cls._tasks[task.name] = task
        return task

    @classmethod
    def get(cls, name: str) -> TaskSpec:
        if name not in cls._tasks:
            raise ValueError(f"unknown task {name!r}")
        return cls._tasks[name]

    @classmethod
    def remove(cls, name: str) -> None:
        cls._tasks.pop(name, None)

    @classmethod
    def names(cls) -> list[str]:
        return sorted(cls._tasks)

    @classmethod
    def reset(cls) -> None:
        cls._tasks.clear()
