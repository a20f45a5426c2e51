"""Vector operators (V1-V5).

Pooling is done as an aggregation over exploded ``(sequence, dim, value)``
rows, so Spark's partial aggregation merges the sums map-side and no task ever
holds a whole long sequence.  Results come back as ``(sequence, dim, value)``
rows, or re-assembled into one array per sequence (bounded by the dimension).
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _explode_dims(df: DataFrame, seq: str, pos: str, vec: str, extra: list[str] = ()) -> DataFrame:
    return df.select(seq, pos, *extra, F.posexplode(vec).alias("dim", "value"))


def masked_pool(df: DataFrame, seq: str = "seq", pos: str = "pos", vec: str = "vec", mask: str = "mask",
                sqrt: bool = True) -> DataFrame:
    """V2: Σ mask·h / √Σ mask per sequence (plain masked mean with ``sqrt=False``)."""
    e = _explode_dims(df, seq, pos, vec, [mask])
    m = F.col(mask).cast("double")
    g = e.groupBy(seq, "dim").agg(F.sum(m * F.col("value")).alias("s"), F.sum(m).alias("n"))
    den = F.sqrt("n") if sqrt else F.col("n")
    return g.select(seq, "dim", F.try_divide(F.col("s"), den).alias("value"))


def span_pool(df: DataFrame, start: int | str, end: int | str, seq: str = "seq", pos: str = "pos", vec: str = "vec",
              end_inclusive: bool = True) -> DataFrame:
    """V3: mean of the vectors at positions ``start..end`` (inclusive end by default)."""
    s = F.lit(start) if isinstance(start, int) else F.col(start)
    t = F.lit(end) if isinstance(end, int) else F.col(end)
    inside = (F.col(pos) >= s) & ((F.col(pos) <= t) if end_inclusive else (F.col(pos) < t))
    e = _explode_dims(df.where(inside), seq, pos, vec)
    return e.groupBy(seq, "dim").agg(F.avg("value").alias("value"))


def start_pool(df: DataFrame, at: int | str = 0, seq: str = "seq", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """V4: the vector at position ``at`` (first token by default)."""
    a = F.lit(at) if isinstance(at, int) else F.col(at)
    return _explode_dims(df.where(F.col(pos) == a), seq, pos, vec).select(seq, "dim", F.col("value").cast("double"))


def to_arrays(pooled: DataFrame, seq: str = "seq", out: str = "vec") -> DataFrame:
    """``(seq, dim, value)`` → one array per sequence (size = dimension, bounded)."""
    return pooled.groupBy(seq).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s.getField("value")).alias(out))


def concat_pool(parts: list[DataFrame], seq: str = "seq") -> DataFrame:
    """V5: concatenate pooled vectors (e.g. sentence, subject, object) dimension-wise."""
    out = None
    for i, p in enumerate(parts):
        moved = p.select(seq, F.col("dim").alias("_d"), "value", F.lit(i).alias("_part"))
        out = moved if out is None else out.unionByName(moved)
    dims = out.groupBy("_part").agg(F.max("_d").alias("_w"))
    from pyspark.sql.window import Window

    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part: bounded, safe to window and broadcast
    offs = dims.select("_part", F.coalesce(F.sum(F.col("_w") + 1).over(w), F.lit(0)).alias("_off"))
    return out.join(F.broadcast(offs), "_part").select(seq, (F.col("_d") + F.col("_off")).cast("int").alias("dim"),
                                                       "value")


def fused_pools(df: DataFrame, span: tuple[int, int] = (1, 4), at: int = 0, seq: str = "seq", pos: str = "pos",
                vec: str = "vec", mask: str = "mask") -> DataFrame:
    """V5 over one pass: [vector at ``at``, mean over ``span`` (inclusive), masked √n pool] per sequence.

    One explode and one aggregation with conditional sums per (sequence, dim),
    instead of one pass per pooled part; output dims of part ``i`` are shifted
    by ``i`` · dimension.
    """
    e = df.select(seq, pos, mask, F.size(vec).alias("_d"), F.posexplode(vec).alias("dim", "value"))
    v = F.col("value").cast("double")
    in_span = (F.col(pos) >= span[0]) & (F.col(pos) <= span[1])
    m = F.col(mask).cast("double")
    g = e.groupBy(seq, "dim").agg(
        F.max("_d").alias("_d"),
        F.max(F.when(F.col(pos) == at, v)).alias("p0"),
        F.avg(F.when(in_span, v)).alias("p1"),
        F.try_divide(F.sum(m * v), F.sqrt(F.sum(m))).alias("p2"))
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"p{i}").alias("v")) for i in range(3)])
    out = g.select(seq, "dim", "_d", F.explode(parts).alias("x")).where(F.col("x.v").isNotNull())
    return out.select(seq, (F.col("x.i") * F.col("_d") + F.col("dim")).cast("int").alias("dim"),
                      F.col("x.v").alias("value"))


def batch_score(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], inputs: str, out: str = "predictions",
                out_type: T.DataType = T.ArrayType(T.DoubleType()), keep: list[str] | None = None) -> DataFrame:
    """V1: run a user model on Arrow batches (``mapInPandas``); ``fn`` maps a 2-D array to outputs.

    The callable is shipped once per task; it should load its weights lazily.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != inputs]
    fields = [f for f in df.schema.fields if f.name in keep] + [T.StructField(out, out_type)]
    schema = T.StructType(fields)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[inputs].to_numpy())
            y = fn(x)
            res = pdf[keep].copy()
            res[out] = list(y) if getattr(y, "ndim", 1) > 1 else y
            yield res

    return df.mapInPandas(run, schema)


def linear_model(weights: np.ndarray, bias: np.ndarray | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """A simple user callable for V1: ``x @ W + b``."""
    w = np.asarray(weights, dtype=np.float64)
    b = np.zeros(w.shape[1]) if bias is None else np.asarray(bias, dtype=np.float64)

    def fn(x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) @ w + b

    return fn
