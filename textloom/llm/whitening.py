"""Embedding whitening: distributed centred covariance, leading eigenpairs of a tridiagonal form, broadcast projection.

Spark sums the integer vectors, then the products of the centred ones, task by task; only ``d`` sums and ``d * d``
products of ``d`` dimensions reach the driver, at any number of rows. There the covariance is brought to tridiagonal
form by Householder reflections, its leading eigenvalues are bracketed by Sturm counts and halved down to rounding, and
inverse iteration gives their vectors, reorthogonalised inside clusters of close eigenvalues. The ``k`` unit vectors are
broadcast, every row is projected where it lies, and the covariance of what came out is summed the same way.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import materialise, read_table

#: Components returned; entries become ``floor(SCALE * c) + OFFSET``.
COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
#: A component whose variance is below this share of the largest cannot be told from rounding.
FLAT = 1e-10

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(col: pa.Array, scale: int = SCALE, offset: int = OFFSET) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, x)``: which vectors are whole and finite, and their integer form, one row each.

    Raises ``ValueError`` where whole vectors differ in length or an integer leaves the range of a long.
    """
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    end = np.cumsum(size)
    rows = np.flatnonzero((size > 0) & (bad[end] == bad[end - size]))
    if not len(rows):
        return rows, np.zeros((0, 0), np.int64)
    d = size[rows[0]]
    if (size[rows] != d).any():
        raise ValueError(f"vectors of {d} and of {size[rows][size[rows] != d][0]} entries")
    x = np.floor(flat[(end - size)[rows][:, None] + np.arange(d)] * scale)
    if (np.abs(x) >= 2.0 ** 62).any():
        raise ValueError("a vector's entry is too large for its integer form")
    return rows, x.astype(np.int64) + offset


def totals(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray | None], kind: str) -> np.ndarray:
    """Sum over all rows of the vectors that ``fn`` gives per batch, each task adding up its own first.

    ``kind`` is ``long`` or ``double``. The result is as long as one vector, whatever the number of rows; vectors of
    different lengths raise ``ValueError``. Without any vector it is empty.
    """
    arrow = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = fn(batch)
            if part is None:
                continue
            if total is not None and len(total) != len(part):
                raise ValueError(f"vectors of different lengths give {len(total)} and {len(part)} sums")
            total = part if total is None else total + part
        if total is not None:
            size = np.full(len(total), len(total), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(size), pa.array(total, arrow)], names=["at", "size", "value"])

    parts = df.mapInArrow(run, f"at long, size long, value {kind}")
    rows = parts.groupBy("at").agg(F.sum("value").alias("value"), F.min("size").alias("low"), F.max("size").alias("high")).collect()
    if any(r.low != r.high for r in rows):
        raise ValueError("vectors of different lengths")
    return np.array([r.value for r in sorted(rows, key=lambda r: r.at)], np.int64 if kind == "long" else np.float64)


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """``x - s / n`` from the exact integer ``n * x - s``."""
    return (n * x - s) / n


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """Exact sums of ``(n * x - s) ** 2``; null where one leaves the range of a long."""
    c = n * x - s
    if len(c) and float(np.abs(c).max()) ** 2 * c.shape[1] < 2.0 ** 62:
        return (c * c).sum(axis=1).tolist()
    exact = (c.astype(object) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact]


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reduction of a symmetric matrix: diagonal, off-diagonal and the unit normals of the reflections."""
    a, d = a.copy(), len(a)
    normals = []
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        v = x.copy()
        v[0] += norm if x[0] >= 0 else -norm
        size = np.linalg.norm(v)
        if norm == np.abs(x[0]) or size == 0:  # already in form
            normals.append(np.zeros_like(v))
            continue
        v /= size
        normals.append(v)
        block = a[k + 1:, k + 1:]
        p = 2 * block @ v
        w = p - (v @ p) * v
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -norm if x[0] >= 0 else norm
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), normals


def reflect_back(y: np.ndarray, normals: list[np.ndarray]) -> np.ndarray:
    """Vectors (columns of ``y``) of the tridiagonal form as vectors of the matrix it came from."""
    y = y.copy()
    for k in range(len(normals) - 1, -1, -1):
        v, part = normals[k], y[k + 1:]
        part -= 2 * np.outer(v, v @ part)
    return y


def below(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: number of eigenvalues below each value of ``at``."""
    tiny = np.finfo(float).tiny * 1e16 + np.finfo(float).eps * np.finfo(float).eps * (np.abs(off).max() if len(off) else 0)
    count = np.zeros(len(at), np.int64)
    q = np.ones(len(at))
    for i in range(len(diag)):
        q = diag[i] - at - (off[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues in falling order, each halved down to neighbouring doubles."""
    d = len(diag)
    radius = np.zeros(d)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    edge = max(np.abs(diag + radius).max(), np.abs(diag - radius).max()) * (1 + 1e-12) + np.finfo(float).tiny
    want = d - 1 - np.arange(k)  # 0-based in rising order
    low, high = np.full(k, -edge), np.full(k, edge)
    while True:
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high) | (high - low <= np.finfo(float).eps * edge / 8)).all():
            return mid
        right = below(diag, off, mid) <= want
        low, high = np.where(right, mid, low), np.where(right, high, mid)


def solve(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """``(T - shift) y = b`` by elimination with row exchanges; a zero pivot counts as ``tiny``."""
    d = len(diag)
    u, v, w = (diag - shift).tolist(), [*off.tolist(), 0.0], [0.0] * d  # diagonal and the two rows above it
    y, lower = b.tolist(), [*off.tolist(), 0.0]
    for i in range(d - 1):
        if abs(lower[i]) > abs(u[i]):  # exchange rows i and i + 1
            u[i], lower[i] = lower[i], u[i]
            v[i], u[i + 1] = u[i + 1], v[i]
            w[i], v[i + 1] = v[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(u[i]) < tiny:
            u[i] = tiny
        m = lower[i] / u[i]
        u[i + 1] -= m * v[i]
        v[i + 1] -= m * w[i]
        y[i + 1] -= m * y[i]
    if abs(u[-1]) < tiny:
        u[-1] = tiny
    for i in range(d - 1, -1, -1):
        t = y[i]
        if i + 1 < d:
            t -= v[i] * y[i + 1]
        if i + 2 < d:
            t -= w[i] * y[i + 2]
        y[i] = t / u[i]
    return np.array(y)


def inverse_iteration(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) for eigenvalues in falling order; those of a cluster are kept orthogonal."""
    d, eps = len(diag), np.finfo(float).eps
    norm = max(np.abs(diag).max() + 2 * (np.abs(off).max() if len(off) else 0), np.finfo(float).tiny / eps)
    rng = np.random.Generator(np.random.PCG64(17))
    out = np.zeros((d, len(values)))
    first, shift = 0, values[0]
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first = k
        # equal eigenvalues are shifted apart so that their solves differ
        shift = min(value, shift - 10 * eps * norm) if k > first else value
        y = rng.standard_normal(d)
        for _ in range(5):
            y /= np.abs(y).max()
            y = solve(diag, off, shift, y, eps * norm)
            for _ in range(2):
                near = out[:, first:k]
                y -= near @ (near.T @ y)
            y /= np.linalg.norm(y)
        out[:, k] = y
    return out


def eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` leading eigenvalues of a symmetric matrix and their unit vectors (rows)."""
    size = float(np.abs(v).max())
    if size == 0:
        return np.zeros(k), np.eye(len(v))[:k]
    diag, off, normals = tridiagonal(v / size)
    values = leading(diag, off, k)
    return values * size, reflect_back(inverse_iteration(diag, off, values), normals).T


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened leading components of all vectors, one row per vector and component.

    A vector that is null, empty or holds a null or non-finite entry is dropped. Each entry ``c`` becomes
    ``x = floor(scale * c) + offset``; mean and covariance (divisor ``n``) are those of all remaining vectors, repeated
    ones counted as often as they stand. Returns ``vec_id, component`` (from 1 by falling variance, at most
    ``components`` and the dimension), ``n``, ``deviation`` (exact sum over dimensions of ``(n * x - sum) ** 2``, null
    beyond a long), ``whitened`` (the centred vector projected on the component, over its standard deviation),
    ``explained`` (the component's share of the variance) and ``identity_error`` (largest absolute entry of the
    whitened vectors' covariance minus the identity). A component without variance (less than ``FLAT`` of the
    largest), as with fewer vectors than dimensions or equal ones, has null ``whitened`` and takes no part in
    ``identity_error``; without any variance ``explained`` and ``identity_error`` are null too. Null ids are kept, other
    columns are ignored, and an empty table gives an empty result. Vectors of different lengths and integers beyond
    a long raise ``ValueError``. The driver holds ``d * d`` sums for ``d`` dimensions.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    def sums(batch):
        x = integers(batch.column(1), scale, offset)[1]
        return np.concatenate([[len(x)], x.sum(axis=0)]) if len(x) else None

    total = totals(rows, sums, "long")
    if not len(total):
        return spark.createDataFrame([], SCHEMA)
    n, s = int(total[0]), total[1:]
    d = len(s)

    def products(batch):
        x = integers(batch.column(1), scale, offset)[1]
        c = centred(x, n, s) if len(x) else None
        return None if c is None else (c.T @ c)[np.triu_indices(d)]

    v = np.zeros((d, d))
    v[np.triu_indices(d)] = totals(rows, products, "double") / n
    v = v + np.triu(v, 1).T
    trace = float(np.trace(v))
    k = min(components, d)
    values, units = eigenpairs(v, k)
    usable = (values > FLAT * values[0]) & (values > 0)
    m = int(usable.sum())  # values fall, so the usable ones come first
    projection = spark.sparkContext.broadcast((units[:m] / np.sqrt(values[:m])[:, None]).T)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch.column(1), scale, offset)
            if not len(at):
                continue
            white = centred(x, n, s) @ projection.value
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * m), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(deviations(x, n, s), pa.int64()), lists], names=["vec_id", "deviation", "white"])

    white = materialise(rows.mapInArrow(project, "vec_id long, deviation long, white array<double>"), "whitened")
    error = None
    if m:
        def matrix(batch):
            return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)

        only = white.select("white")
        mean = totals(only, lambda batch: matrix(batch).sum(axis=0) if batch.num_rows else None, "double") / n

        def again(batch):
            c = matrix(batch) - mean
            return (c.T @ c).ravel() if batch.num_rows else None

        error = float(np.abs(totals(only, again, "double").reshape(m, m) / n - np.eye(m)).max())
    explained = [float(e) / trace if trace > 0 else None for e in values]
    number = F.explode(F.sequence(F.lit(1), F.lit(k)))
    out = white.select("vec_id", number.alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "white")
    shares = F.array(*[F.lit(e).cast("double") for e in explained])
    return out.select("vec_id", "component", "n", "deviation", F.get("white", F.col("component") - 1).alias("whitened"),
                      F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitening of the whole ``embeddings`` table."""
    return whiten(read_table(spark, sf_dir, "embeddings"))
