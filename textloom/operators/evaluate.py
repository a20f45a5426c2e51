"""A whole evaluation run: prepare, score, join, post-process, metrics per batch, meter, history, best step."""

from __future__ import annotations

import inspect
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.inference import score_batches
from textloom.operators.metrics import meter_average, metric_history
from textloom.operators.ranking import global_index
from textloom.spec import TaskSpec


def batch_metrics(task: TaskSpec, scored: DataFrame, batch_col: str = "batch") -> DataFrame:
    """``(batch, metric, score, count)`` of every metric of the task that the rows have columns for.

    Metrics of a task take the scored rows and, by keyword, the columns that group them.
    """
    out = None
    for metric in task.metrics:
        if "group" not in inspect.signature(metric).parameters:
            raise ValueError(f"{getattr(metric, '__name__', metric)} of task {task.name} takes no group")
        r = metric(scored, group=[batch_col])
        if r is not None:
            r = r.select(batch_col, "metric", "score", "count")
            out = r if out is None else out.unionByName(r)
    return out


def evaluate(task: TaskSpec, prepared: DataFrame, models: dict[int, Callable[[], object]], inputs: list[str], order: list[str],
             method: str = "forward", constants: dict | None = None, out_type: str = "int", logit_to_id: bool = True, batch_size: int = 24,
             id_col: str = "id", tag: str = "eval", words: Column | None = None) -> DataFrame:
    """History of a task over model steps: ``(task, tag, metric, step, score, count, line, is_best)``.

    Each model reads only its input columns of ``prepared`` and gives ``(id, predictions)``; predictions meet the
    targets again by ``id_col`` (unique).  Rows are dealt into batches of ``batch_size`` in ``order``; a metric is taken per
    batch and averaged by count, as the reference's meter does; the task's selector marks each step that was the best so far.
    """
    targets = global_index(prepared, order, "_pos").withColumn("batch", F.floor(F.col("_pos") / batch_size)).drop("_pos")
    history = None
    for step, load in sorted(models.items()):
        predicted = score_batches(prepared.select(id_col, *[c for c in inputs if c in prepared.columns]), load, inputs, method, constants,
                                  logit_to_id, "predictions", out_type, keep=[id_col])
        scored = targets.join(predicted, id_col)
        if task.postprocess:
            takes_words = "words" in inspect.signature(task.postprocess).parameters
            scored = task.postprocess(scored, words=words) if takes_words else task.postprocess(scored)
        line = meter_average(batch_metrics(task, scored)).withColumn("step", F.lit(step))
        history = line if history is None else history.unionByName(line)
    return task.mark_best(metric_history(history, task.name, tag))
