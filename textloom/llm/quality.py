"""Quality classifier by co-training of two views.

View 1 is the text's content: hashed byte trigrams and how varied its words are. View 2 is what describes the page:
source, language, length and layout (lines, kinds of characters). A logistic model per view is fitted on labelled
documents. In each round each model scores all unlabelled documents, and those it is surest about go to the other
view's training set with the label it gave them, as many of each class as the labelled set's balance asks for. At
the end both views are calibrated on labelled documents that took no part, and the mean of their calibrated log odds
scores all documents.

Features of every row are computed once and stored. A round is a pass over them in which tasks score the rows; the
surest of all are ranked by Spark and only those, ``per_round`` a view, reach the driver. The labelled rows that the
models start from are a bounded sample (``labelled``, by a hash of the id). Scoring covers every row and whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.batches import fan_out
from textloom.llm import textbytes as tb
from textloom.llm.common import documents, materialise, read_table

#: Buckets of the hashed byte trigrams, of sources and of languages.
TRIGRAMS, SOURCES, LANGS = 2048, 64, 16
N_STATS, N_META = 4, 14
WIDTH = (TRIGRAMS + N_STATS, SOURCES + LANGS + N_META)
#: Most labelled rows that the models are fitted on.
LABELLED = 6000
ROUNDS, PER_ROUND = 4, 300
#: Raw log odds from which a view may teach the other.
SURE = 1.0
#: Shares of a list of sure rows that are cut to what is wanted in parallel.
SHARES = 64

_KINDS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 end of sentence, 6 other ASCII sign, 7 beyond ASCII
_KINDS[33:127] = 6
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 1, 2, 3
_KINDS[[32, 9, 10, 11, 12, 13]] = 4
_KINDS[[44, 46, 63]] = 5
_KINDS[128:] = 7


def _hashed(values: list, buckets: int) -> np.ndarray:
    """Bucket of each of a few distinct strings; null has the last one."""
    import zlib

    return np.array([buckets - 1 if v is None else zlib.crc32(v.encode()) % (buckets - 1) for v in values], dtype=np.int64)


def features(raw: np.ndarray, off: np.ndarray, source: list, lang: list) -> tuple[np.ndarray, np.ndarray]:
    """The feature matrices of the two views for the rows of a slice."""
    n = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    content = np.zeros((n, WIDTH[0]), dtype=np.float32)
    if len(raw) > 2:
        b = raw.astype(np.uint32)
        t = b[2:] | b[1:-1] << np.uint32(8) | b[:-2] << np.uint32(16)
        t = (t * np.uint32(2654435761)) >> np.uint32(21)
        inside = row[2:] == row[:-2]
        counts = np.bincount(row[2:][inside] * TRIGRAMS + t[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        weight = np.sqrt(counts)
        content[:, :TRIGRAMS] = weight / np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-9)
    s, e, h, first = tb.words(raw, off)
    n_words = np.diff(first)
    word_row = np.repeat(np.arange(n), n_words)
    key = np.unique(np.stack([word_row.astype(np.uint64), h], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
    distinct = np.bincount(key[:, 0].astype(np.int64), minlength=n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1])
    some = np.maximum(n_words, 1)
    mean_word = np.bincount(word_row, weights=e - s, minlength=n) / some
    expected = np.maximum(n_words, 1) ** 0.8
    content[:, TRIGRAMS:] = np.stack([np.minimum(distinct / expected, 3), np.bincount(word_row, weights=again, minlength=n) / some,
                                      np.minimum(mean_word, 20) / 10, n_words == 0], axis=1)
    kinds = np.bincount(row * 8 + _KINDS[raw], minlength=n * 8).reshape(n, 8) / np.maximum(size, 1)[:, None]
    n_lines = np.bincount(row[raw == 10], minlength=n) + 1
    meta = np.zeros((n, WIDTH[1]), dtype=np.float32)
    meta[np.arange(n), _hashed(source, SOURCES)] = 1
    meta[np.arange(n), SOURCES + _hashed(lang, LANGS)] = 1
    meta[:, SOURCES + LANGS:SOURCES + LANGS + 8] = kinds * 4
    meta[:, SOURCES + LANGS + 8:] = np.stack([np.log1p(size) / 5, np.log1p(n_lines) / 3, np.log1p(size / n_lines) / 5, np.log1p(n_words) / 5,
                                              kinds[:, 2] / np.maximum(kinds[:, 1] + kinds[:, 2], 1e-9), kinds[:, 6] * 20], axis=1)
    return content, meta


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds."""
        return self.slope * self.raw(x) + self.offset


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 300) -> Model:
    """Logistic regression by accelerated gradient descent; deterministic."""
    w = np.zeros(x.shape[1] + 1)  # the last one is the bias
    rate = 4.0 / max(1e-9, float(np.einsum("ij,ij->", x, x)) / max(1, len(x)) + 1.0)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        off = ((_sigmoid(x @ v[:-1].astype(np.float32) + np.float32(v[-1])) - y) / len(y)).astype(np.float32)
        g = np.append(x.T @ off, off.sum()).astype(np.float64) + l2 * np.append(v[:-1], 0.0)
        new = v - rate * g
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Platt scaling on rows that the model was not fitted on."""
    z = model.raw(x).astype(np.float64)
    hits, n = y.sum(), len(y)
    goal = np.where(y > 0, (hits + 1) / (hits + 2), 1 / (n - hits + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's method on two parameters
        p = _sigmoid(a * z + b)
        g = np.array([((p - goal) * z).sum(), (p - goal).sum()])
        s = p * (1 - p) + 1e-9
        hess = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.weight, model.bias, float(max(a, 1e-3)), float(b))


class CoTraining:
    """The rounds on the driver: training sets that grow by what the views teach each other.

    ``views`` and ``y`` are the labelled rows; every fifth is kept for calibration only. ``wanted`` lists what the
    next round asks for, ``give`` adds the rows found for it, ``calibrated`` ends with the two models.
    """

    def __init__(self, views: list[np.ndarray], y: np.ndarray, per_round: int = PER_ROUND):
        held = np.arange(len(y)) % 5 == 4
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held = np.zeros(len(y), bool)
        share = y[~held].mean()
        self.at = held if held.any() else ~held
        self.labelled, self.y = views, y
        self.x = [[v[~held]] for v in views]
        self.labels = [[y[~held]] for _ in views]
        self.most = {1.0: round(per_round * share), 0.0: per_round - round(per_round * share)}
        #: keys of the rows that each view has been given
        self.given: list[set[int]] = [set(), set()]
        self.fit()

    def fit(self) -> None:
        self.models = [fit(np.concatenate(a), np.concatenate(b)) for a, b in zip(self.x, self.labels)]

    def wanted(self) -> list[tuple[int, int, float, int]]:
        """``(teacher, pupil, label, most rows)``."""
        return [(t, 1 - t, label, most) for t in (0, 1) for label, most in self.most.items()]

    def give(self, pupil: int, label: float, keys: list[int], rows: np.ndarray) -> None:
        self.given[pupil] |= set(keys)
        self.x[pupil].append(rows)
        self.labels[pupil].append(np.full(len(rows), label))

    def calibrated(self) -> list[Model]:
        return [calibrate(m, v[self.at], self.y[self.at]) for m, v in zip(self.models, self.labelled)]


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, off = tb.buffers(_column(batch, "text"))
    source, lang = _column(batch, "source").to_pylist(), _column(batch, "lang").to_pylist()
    for a, b in tb.slices(off):
        for c in range(a, b, 2048):  # many short rows: bound the matrices as well
            d = min(b, c + 2048)
            yield c, d, *features(raw[off[c]:off[d]], off[c:d + 1] - off[c], source[c:d], lang[c:d])


#: What a view's features are stored as: the content in half precision, the page in single precision.
_STORED = (np.float16, np.float32)
#: Bytes of the content's bits: one per column, set where the value is not zero. The other values follow them; texts
#: hold a fourth of the trigrams' buckets, and what travels between Spark and Python is that much smaller.
_BITS = (WIDTH[0] + 7) // 8


def _binary(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per row from the bytes of all, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def _packed(view: int, rows: np.ndarray) -> pa.Array:
    """The rows of a view's matrix as they are stored."""
    if view:
        return _binary(rows.reshape(-1).view(np.uint8), np.arange(len(rows) + 1) * rows.shape[1] * rows.itemsize)
    some = rows != 0
    bounds = np.concatenate([[0], np.cumsum(_BITS + rows.itemsize * some.sum(axis=1))])
    raw = np.empty(bounds[-1], np.uint8)
    head, rest = _heads(bounds)
    raw[head] = np.packbits(some, axis=1)
    raw[rest] = rows[some].view(np.uint8)
    return _binary(raw, bounds)


def _heads(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(places of the bits of each row, whether a byte belongs to the values)``."""
    head = bounds[:-1, None] + np.arange(_BITS)
    rest = np.ones(bounds[-1], bool)
    rest[head] = False
    return head, rest


def _features(text: pa.Array, source: pa.Array, lang: pa.Array) -> pa.Array:
    """Both views of each row as bytes."""
    batch = pa.RecordBatch.from_arrays([text, source, lang], names=["text", "source", "lang"])
    views = [np.empty((len(text), w), t) for w, t in zip(WIDTH, _STORED)]
    for a, b, *made in _slices(batch):
        for out, x in zip(views, made):
            out[a:b] = x
    return pa.StructArray.from_arrays([_packed(k, v) for k, v in enumerate(views)], names=["content", "meta"])


def _matrix(view: int, column: pa.Array | pa.ChunkedArray | list) -> np.ndarray:
    """Features of a view in single precision, from a binary column without nulls."""
    column = pa.array(column, pa.large_binary()) if isinstance(column, list) else column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, WIDTH[view]), np.float32)
    raw, off = tb.buffers(column)
    if view:
        return raw.view(_STORED[view]).reshape(-1, WIDTH[view]).astype(np.float32)
    head, rest = _heads(off)
    some = np.unpackbits(raw[head], axis=1, count=WIDTH[view]).view(bool)
    out = np.zeros(some.shape, np.float32)
    out[some] = raw[rest].view(_STORED[view])
    return out


def _scored(models: list[Model], calibrated: bool):
    """Per row the log odds of each view: calibrated, or raw ones that do not depend on the batch's shape."""
    step = 1024 if calibrated else 256  # rows that are widened at a time, to single or double precision

    def run(content: pa.Array, meta: pa.Array) -> pa.Array:
        out = [[], []]
        for a in range(0, len(content), step):
            for view, (model, column) in enumerate(zip(models, (content, meta))):
                x = _matrix(view, column.slice(a, step))
                out[view].append(model.odds(x).astype(np.float64) if calibrated else np.round(x.astype(np.float64) @ model.weight.astype(np.float64) + model.bias, 6))
        z = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.StructArray.from_arrays([pa.array(z[0]), pa.array(z[1])], names=["content", "meta"])

    return F.arrow_udf(run, "content double, meta double")


def surest(rows: DataFrame, training: CoTraining, known: DataFrame) -> dict[tuple[int, float], list[int]]:
    """Keys of the unlabelled rows that each teacher is surest about, per pupil and label, at most as many as it wants.

    All rows are scored in tasks; what is sure enough, has no label and was not given to the pupil before is ranked
    by Spark. Rows that repeat count once; ties go to the smaller key.
    """
    z = rows.select("__id", "__key", _scored(training.models, False)("__content", "__meta").alias("z"))
    lists = []
    for teacher, pupil, label, most in training.wanted():
        sure = (1 if label else -1) * F.col("z.meta" if teacher else "z.content")
        given = F.col("__key").isin(sorted(training.given[pupil])) if training.given[pupil] else F.lit(False)
        lists.append(F.when((sure > SURE) & ~given, F.struct(F.lit(pupil).alias("pupil"), F.lit(label).alias("label"), F.lit(most).alias("most"), sure.alias("sure"))))
    z = z.filter((F.abs("z.content") > SURE) | (F.abs("z.meta") > SURE)).join(known.select(F.col("doc_id").alias("__id")), "__id", "left_anti")
    z = z.select("__key", F.explode(F.array_compact(F.array(*lists))).alias("l")).select("__key", "l.*")
    z = z.groupBy("pupil", "label", "most", "__key").agg(F.max("sure").alias("sure"))
    # first within shares of a list, then among what the shares keep: no task sees a whole list
    most, order = max(training.most.values()), [F.col("sure").desc(), F.col("__key")]
    share = F.row_number().over(Window.partitionBy("pupil", "label", F.pmod("__key", F.lit(SHARES))).orderBy(*order))
    z = z.withColumn("place", share).filter(F.col("place") <= most).filter("place <= most")
    z = z.withColumn("place", F.row_number().over(Window.partitionBy("pupil", "label").orderBy(*order))).filter(F.col("place") <= most).filter("place <= most")
    out: dict[tuple[int, float], list[int]] = {}
    for r in z.select("pupil", "label", "__key").collect():  # at most per_round rows a view
        out.setdefault((r.pupil, r.label), []).append(r["__key"])
    return {k: sorted(v) for k, v in out.items()}


def train(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> list[Model] | None:
    """The two calibrated models from stored features (``__id, __key, __content, __meta``); None if the labels don't hold
    both classes.

    ``labels(doc_id, quality)``: rows with a null id or quality are left out, of rows that repeat an id the largest
    quality counts. The models start from the labelled rows with the smallest hash of their id, at most ``labelled``.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg((F.max("quality") > 0).cast("double").alias("label"))
    ids = rows.select(F.col("__id").alias("doc_id")).filter("doc_id is not null").distinct().join(known, "doc_id")
    some = ids.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(labelled).withColumnRenamed("doc_id", "__id")
    table = rows.join(F.broadcast(some), "__id").select("__id", "__key", "label", "__content", "__meta").toArrow()  # at most ``labelled`` ids
    table = table.sort_by([("__id", "ascending"), ("__key", "ascending")])
    y = table.column("label").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    training = CoTraining([_matrix(v, table.column(c)) for v, c in enumerate(("__content", "__meta"))], y, per_round)
    del table
    for _ in range(rounds):
        found = surest(rows, training, known)
        if not found:
            break
        for pupil, column in enumerate(("__content", "__meta")):
            keys = sorted({k for (p, _), ks in found.items() if p == pupil for k in ks})
            if not keys:
                continue
            mine = {r["__key"]: bytes(r[column]) for r in rows.filter(F.col("__key").isin(keys)).select("__key", column).dropDuplicates(["__key"]).collect()}
            for (p, label), ks in sorted(found.items()):
                if p == pupil:
                    training.give(p, label, ks, _matrix(p, [mine[k] for k in ks]))
        training.fit()
    return training.calibrated()


def quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``quality_score, quality_content, quality_meta`` (probability of good quality) and ``quality_keep``.

    ``docs`` has ``doc_id, text, source, lang``; ``keep`` names the columns passed through (all by default; names that
    start with two underscores are taken). Null or empty texts are scored by their metadata and the features of an
    empty text; null sources and languages are values of their own. If the labels don't hold both classes nothing can
    be learned: all scores are null and every row is kept. Rows that repeat get the same scores and teach once; an
    empty table gives an empty result. Rows and features are stored once below ``spark.checkpoint.dir``.
    """
    keep = list(docs.columns if keep is None else keep)
    text = F.coalesce("text", F.lit(""))
    made = fan_out(_features, "content binary, meta binary", text, F.col("source"), F.col("lang"))  # features are larger than most texts
    rows = docs.select(*[F.col(c).alias(f"__kept_{c}") for c in keep], F.col("doc_id").cast("long").alias("__id"),
                       F.xxhash64("doc_id", "text", "source", "lang").alias("__key"), made.alias("__made"))
    rows = materialise(rows.select("*", F.col("__made.content").alias("__content"), F.col("__made.meta").alias("__meta")).drop("__made"), "quality-features")
    kept = [F.col(f"__kept_{c}").alias(c) for c in keep]
    models = train(rows, labels, labelled)
    if models is None:
        none = F.lit(None).cast("double")
        return rows.select(*kept, none.alias("quality_score"), none.alias("quality_content"), none.alias("quality_meta"), F.lit(True).alias("quality_keep"))
    z = rows.select(*kept, _scored(models, True)("__content", "__meta").alias("__z"))

    def probability(odds):
        return 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))

    score = probability((F.col("__z.content") + F.col("__z.meta")) / 2)
    return z.select(*keep, score.alias("quality_score"), probability(F.col("__z.content")).alias("quality_content"),
                    probability(F.col("__z.meta")).alias("quality_meta"), (score >= 0.5).alias("quality_keep"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of the whole ``documents`` table, learned from ``labels``."""
    return quality(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"), keep=["doc_id"])
