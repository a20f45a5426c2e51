"""Best-so-far selection over a metric history.

Windows are always partitioned by ``(task, metric)``: one history has one row
per evaluation step, so a partition is as long as a run's step count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["task", "metric"]


def _prior(agg, keys: list[str], step: str, score: str):
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return agg(score).over(w)


def greater_is_best(df: DataFrame, keys: list[str] = KEYS, step: str = "step", score: str = "score",
                    out: str = "is_best") -> DataFrame:
    """Best when strictly above every earlier score (start −inf)."""
    prev = F.coalesce(_prior(F.max, keys, step, score), F.lit(float("-inf")))
    return df.withColumn(out, F.col(score) > prev)


def less_is_best(df: DataFrame, keys: list[str] = KEYS, step: str = "step", score: str = "score",
                 out: str = "is_best") -> DataFrame:
    """Best when strictly below every earlier score (start +inf)."""
    prev = F.coalesce(_prior(F.min, keys, step, score), F.lit(float("inf")))
    return df.withColumn(out, F.col(score) < prev)


def always_best(df: DataFrame, out: str = "is_best") -> DataFrame:
    """Every step is best (the default when a task sets no selector)."""
    return df.withColumn(out, F.lit(True))


def best_step(df: DataFrame, keys: list[str] = KEYS, step: str = "step", score: str = "score",
              greater: bool = True) -> DataFrame:
    """The step whose checkpoint survives = the earliest step holding the best score."""
    s = F.col(score) if greater else -F.col(score)
    return df.groupBy(*keys).agg(
        F.max_by(F.col(step), F.struct(s, -F.col(step))).alias("best_step"),
        (F.max(F.col(score)) if greater else F.min(F.col(score))).alias("best_score"),
    )
