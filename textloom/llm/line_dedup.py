"""Line dedup by winnowing over line hashes.

A run of consecutive lines with at least ``min_words`` words that stands earlier in the corpus (by id, then line) is
deleted from where it stands again. Per line there are two windows: the shortest stretch of lines from it forwards,
and from it backwards, that holds ``min_words`` words. The line with the smallest hash in a window is its
fingerprint. A repeated run of that many words contains a whole window in both places, and equal windows choose
equal fingerprints, so every repeated run is met at a fingerprint.

Fingerprints that stand in one place only are dropped; the positions of the others are joined, and the match is
extended both ways to the whole window by comparing the hash of all its lines with the earliest equal window. Each
line of a repeated run lies in a forward or a backward window of it, so the deleted windows together are the whole
run. All groups are reduced to their earliest place, so a line that a third of the corpus holds costs no pairs.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.batches import fan_out
from textloom.llm import textbytes as tb
from textloom.llm.common import attach, documents, materialise, per_batch

MIN_WORDS = 50

_WINDOWS = "doc_id long, version long, first int, last int, print_line int, fingerprint long, run_hash long"
_WINDOW_SCHEMA = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("print_line", pa.int32()),
                            ("fingerprint", pa.int64()), ("run_hash", pa.int64())])


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Position of the smallest of ``values[lo:hi]`` (the first one of equals) for many ranges: a sparse table."""
    n = len(values)
    table = [np.arange(n)]
    span = 1
    longest = int((hi - lo).max()) if len(lo) else 0
    while 2 * span <= longest:
        prev = table[-1]
        a, b = prev[:n - 2 * span + 1], prev[span:n - span + 1]
        table.append(np.where(values[b] < values[a], b, a))
        span *= 2
    out = np.empty(len(lo), np.int64)
    level = np.floor(np.log2(np.maximum(hi - lo, 1))).astype(np.int64)
    for k, t in enumerate(table):
        at = np.flatnonzero(level == k)
        a, b = t[lo[at]], t[hi[at] - (1 << k)]
        out[at] = np.where(values[b] < values[a], b, a)
    return out


def line_windows(raw: np.ndarray, offsets: np.ndarray, min_words: int):
    """Windows of all rows: ``(row, first, last, print line, fingerprint, run hash)``; lines are counted within a row.

    Lines without words are passed over: they neither count nor hide that two runs are equal.
    """
    ls, le, lfirst = tb.lines(raw, offsets)
    ws, we, wh, _ = tb.words(raw, offsets, lower=False)
    words = np.searchsorted(ws, le) - np.searchsorted(ws, ls)
    full = np.flatnonzero(words > 0)
    line_row = np.searchsorted(lfirst, full, side="right") - 1
    h = tb.span_hash(raw, ls[full], le[full])
    count = words[full]
    cum = np.concatenate([[0], np.cumsum(count)])
    n = len(full)
    row_end = np.searchsorted(line_row, line_row, side="right")
    row_start = np.searchsorted(line_row, line_row, side="left")
    idx = np.arange(n)
    # forward: from line i to the first line at which min_words are reached; backward: the same from line i back
    to = np.searchsorted(cum, cum[:-1] + min_words, side="left")
    back = np.searchsorted(cum, cum[1:] - min_words, side="right") - 1
    fwd = to <= row_end
    bwd = (cum[1:] - cum[row_start]) >= min_words if n else np.zeros(0, bool)
    lo = np.concatenate([idx[fwd], back[bwd]])
    hi = np.concatenate([to[fwd], idx[bwd] + 1])
    both = np.unique(np.stack([lo, hi], axis=1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
    lo, hi = both[:, 0], both[:, 1]
    pos = _range_min(h, lo, hi)
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * tb.powers(tb._P, n), dtype=np.uint64)])
    run = (acc[hi] - acc[lo]) * tb.powers(tb._P_INV, n + 1)[lo]
    run = tb.mix(run + (hi - lo).astype(np.uint64))
    row = line_row[lo] if len(lo) else np.zeros(0, np.int64)
    base = lfirst[row]
    return row, full[lo] - base, full[hi - 1] - base, full[pos] - base, h[pos], run


def _windows(min_words: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_numpy()
        versions = batch.column(1).to_numpy()
        raw, off = tb.buffers(batch.column(2))
        for a, b in tb.slices(off):
            row, first, last, at, fp, rh = line_windows(raw[off[a]:off[b]], off[a:b + 1] - off[a], min_words)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][row]), pa.array(versions[a:b][row]), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(at, pa.int32()),
                                              pa.array(fp.view(np.int64)), pa.array(rh.view(np.int64))], schema=_WINDOW_SCHEMA)

    return run


def _version(text: Column) -> Column:
    """Tells texts of the same id apart: line numbers hold for one text only."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, version, first, last)``: windows of lines that stand earlier in the corpus, to be deleted."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), _version(F.col(text_col)).alias("version"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    windows = materialise(rows.mapInArrow(per_batch(_windows(min_words)), _WINDOWS), "windows")
    total = max(1, windows.count())
    place = F.struct("doc_id", "version", "print_line")
    prints = (windows.groupBy("fingerprint").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"))
              .filter("low <> high").select("fingerprint", "n"))
    met = attach(windows, prints, ["fingerprint"], F.col("n"), total, F.struct("doc_id", "first")).filter("n is not null").drop("n")
    met = materialise(met, "positions")
    runs = (met.groupBy("run_hash").agg(F.min(F.struct("doc_id", "version", "first", "last")).alias("origin"),
                                        F.max(F.struct("doc_id", "version", "first")).alias("latest"), F.count("*").alias("n"))
            .filter("latest > struct(origin.doc_id, origin.version, origin.first)").select("run_hash", "origin", "n"))
    out = attach(met, runs, ["run_hash"], F.col("n"), total, F.struct("doc_id", "first")).filter("origin is not null")
    # within one document a run has to begin after the first one's end
    return out.filter("doc_id <> origin.doc_id or version <> origin.version or first > origin.last").select("doc_id", "version", "first", "last")


def _cut(texts: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
    """``{text, n_lines, n_removed}`` per text, without the lines of its windows."""
    out = []
    for text, first, last in zip(texts.to_pylist(), firsts, lasts):
        if text is None:
            out.append((None, 0, 0))
            continue
        if not first.is_valid:
            out.append((text, text.count("\n") + 1, 0))
            continue
        lines = text.split("\n")
        step = np.zeros(len(lines) + 1, np.int64)
        np.add.at(step, first.values.to_numpy(), 1)
        np.add.at(step, last.values.to_numpy() + 1, -1)
        gone = np.cumsum(step[:-1]) > 0
        out.append(("\n".join(x for x, g in zip(lines, gone) if not g), len(lines), int(gone.sum())))
    names = ["text", "n_lines", "n_removed"]
    cols = zip(*out) if out else [[], [], []]
    return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=names)


def _cut_rows(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__cut``: the struct of ``_cut``."""
    cuts = repeated_runs(docs, min_words, id_col, text_col).groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "last")).alias("c"))
    cuts = cuts.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("c.first").alias("__first"), F.col("c.last").alias("__last"))
    rows = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__version", _version(F.col(text_col)))
    rows = rows.join(cuts, ["__id", "__version"], "left")
    # the texts of a batch are cut step by step: as Python strings, split and joined they are several times the batch
    return rows.withColumn("__cut", fan_out(_cut, "text string, n_lines long, n_removed long", F.col(text_col), F.col("__first"), F.col("__last")))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated runs of lines deleted from ``text_col``; all rows and columns stay.

    Lines end at ``\\n`` and are compared as they are. The first place of a run, by id, text and line, keeps it; runs of
    fewer than ``min_words`` words stay wherever they are. A text all of whose lines are deleted becomes empty; a
    null text stays null. Rows with a null id neither lose lines nor count as a place. Rows that repeat an id and its
    text are one document at the same place: none of them is a later copy of the other. Different texts of one id are
    documents of their own, in the order of a 64-bit hash of the text. Empty tables give empty results.
    """
    columns = [F.col("__cut.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return _cut_rows(docs, min_words, id_col, text_col).select(*columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of the whole ``documents`` table: per row its lines, those deleted, and what is left."""
    left = F.coalesce(F.col("__cut.text"), F.lit(""))
    return _cut_rows(documents(spark, sf_dir), MIN_WORDS, "doc_id", "text").select(
        "doc_id", "__cut.n_lines", "__cut.n_removed", F.length(left).cast("long").alias("n_chars"), F.sha2(left, 256).alias("text_sha256"))
