"""Token-array functions (T1-T9) and vocabularies.

A tokenizer turns a text column into ``ARRAY<STRUCT<tok, id, start, end>>``
(``start`` inclusive, ``end`` exclusive, both 0-based code-point offsets).

* ``HashVocab`` (default) is pure Catalyst: words are maximal runs between the
  separator characters, ids come from an md5 prefix.  Offsets are computed in
  O(n) per row with higher-order functions (no window, no shuffle).
* ``TableVocab`` is a corpus job (top-V words by count) for decoding and for
  vocabularies that must be dense.
* ``ArrowTokenizer`` calls a user callable once per step over an Arrow batch (plug-in tokenizers).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from typing import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.batches import stepwise
from textloom.functions.hof import let

# ---- fixed values: reserved ids ----
PAD_ID = 0
EOS_ID = 1
UNK_ID = 2
FIRST_WORD_ID = 3
# ---- end of fixed values ----

SEPARATORS = (" ", "\t", "\n", "\r")
SEP_REGEX = "[ \t\n\r]"
_WORD = re.compile("[^ \t\n\r]+")

TOKEN_STRUCT = T.ArrayType(T.StructType([
    T.StructField("tok", T.StringType()),
    T.StructField("id", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
]))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """Non-empty words between separator characters."""
    return F.filter(F.split(_c(text), SEP_REGEX, -1), lambda w: w != F.lit(""))


def word_offsets(text) -> Column:
    """``ARRAY<STRUCT<tok, start, end>>`` of the non-empty words, O(n) per row."""
    t = _c(text)
    pieces = F.split(t, SEP_REGEX, -1)
    chars = F.split(t, "", -1)
    # separator positions: one lambda pass, NULLs dropped by the built-in array_compact
    seps = F.array_compact(F.transform(chars, lambda ch, i: F.when(ch.isin(*SEPARATORS), i)))
    # seps is evaluated once; starts/ends are position-aligned with the pieces
    toks = let(seps, lambda sp: F.transform(
        F.arrays_zip(
            pieces.alias("tok"),
            F.concat(F.array(F.lit(0)), F.transform(sp, lambda p: p + 1)).alias("start"),
            F.concat(sp, F.array(F.length(t))).alias("end"),
        ),
        lambda z: F.struct(z["tok"].alias("tok"), z["start"].alias("start"), z["end"].alias("end")),
    ))
    return F.when(F.length(t) == 0, F.array().cast("array<struct<tok:string,start:int,end:int>>")) \
        .otherwise(F.filter(toks, lambda s: s.getField("tok") != F.lit("")))


@dataclass(frozen=True)
class HashVocab:
    """Stateless vocabulary: id = md5-prefix of the word modulo ``size`` plus 3."""

    size: int = 32000

    def word_id(self, w: Column) -> Column:
        h = F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint")
        return (h % F.lit(self.size) + F.lit(FIRST_WORD_ID)).cast("int")

    def ids(self, text) -> Column:
        return F.transform(words(text), self.word_id)

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """``(start, end)`` of each word, for Arrow batches."""
        return [m.span() for m in _WORD.finditer(text)]

    def batch(self, texts: list[str]) -> list[list[tuple[str, int, int, int]]]:
        """``(tok, id, start, end)`` of each word of each text, for Arrow batches; the same values as ``tokens``."""
        known: dict[str, int] = {}

        def word_id(w: str) -> int:
            i = known.get(w)
            if i is None:
                i = known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.size + FIRST_WORD_ID
            return i

        return [[(w, word_id(w), *m.span()) for m in _WORD.finditer(t) for w in (m.group(),)] for t in texts]

    def tokens(self, text) -> Column:
        return F.transform(
            word_offsets(text),
            lambda s: F.struct(
                s.getField("tok").alias("tok"),
                self.word_id(s.getField("tok")).alias("id"),
                s.getField("start").alias("start"),
                s.getField("end").alias("end"),
            ),
        )


#: Shares of a vocabulary that are cut to their top in parallel.
_PARTS = 32
#: Largest vocabulary that is broadcast to the rows; beyond it the planner picks the join.
BROADCAST_WORDS = 1 << 16


@dataclass(frozen=True)
class TableVocab:
    """Top-``size`` words of a corpus by count (ties by word); ids from 3 in that order, one per word."""

    size: int = 32000

    def build(self, corpus: DataFrame, text_col: str) -> DataFrame:
        from pyspark.sql.window import Window

        counts = corpus.select(F.explode(words(F.col(text_col))).alias("tok")).groupBy("tok").count()
        # the corpus is counted once; each of _PARTS shares of the vocabulary keeps its own top (a limit per task before
        # the shuffle, one per share after it), so the last sort sees _PARTS * size words at most
        share = Window.partitionBy(F.pmod(F.xxhash64("tok"), F.lit(_PARTS))).orderBy(F.col("count").desc(), F.col("tok"))
        best = counts.withColumn("_place", F.row_number().over(share)).where(F.col("_place") <= self.size).drop("_place")
        top = best.orderBy(F.col("count").desc(), F.col("tok")).limit(self.size)
        # ``top`` has at most ``size`` rows, so numbering it in one window is bounded work.
        w = Window.orderBy(F.col("count").desc(), F.col("tok"))
        return top.select("tok", (F.row_number().over(w) + F.lit(FIRST_WORD_ID - 1)).cast("int").alias("id"), "count")

    def encode(self, df: DataFrame, key_cols: list[str], text_col: str, vocab: DataFrame, out_col: str = "ids") -> DataFrame:
        """Explode words, join the vocabulary (broadcast only up to ``BROADCAST_WORDS``), regroup per row (unknown → UNK)."""
        # posexplode_outer keeps rows without words (they come back as an empty array)
        exploded = df.select(*key_cols, F.posexplode_outer(words(F.col(text_col))).alias("pos", "tok"))
        ids = vocab.select("tok", F.col("id").alias("_vid"))
        joined = exploded.join(F.broadcast(ids) if self.size <= BROADCAST_WORDS else ids, "tok", "left")
        return joined.groupBy(*key_cols).agg(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct(
                    "pos", F.coalesce("_vid", F.lit(UNK_ID)).alias("id"))))),
                lambda s: s.getField("id"),
            ).alias(out_col)
        )

    def word_list(self, vocab: DataFrame) -> Column:
        """The words in the order of their ids, as one lazy array of at most ``size`` elements (a scalar subquery)."""
        rows = F.array_sort(F.collect_list(F.struct("id", "tok")))
        return vocab.agg(F.transform(rows, lambda r: r["tok"])).scalar()


class ArrowTokenizer:
    """Plug-in tokenizer: ``fn`` maps the texts of an Arrow batch to one list of ``(tok, id, start, end)`` per text.

    Null texts do not reach the callable and give NULL.
    """

    def __init__(self, fn: Callable[[list[str]], list[list[tuple[str, int, int, int]]]]):
        self.fn = fn

    def batch(self, texts: list[str]) -> list[list[tuple[str, int, int, int]]]:
        out = self.fn(texts) if texts else []
        if len(out) != len(texts):
            raise ValueError(f"the tokenizer gave {len(out)} lists for {len(texts)} texts")
        return out

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return [(t[2], t[3]) for t in self.batch([text])[0]]

    def tokens(self, text) -> Column:
        def some(texts: pa.Array) -> pa.Array:
            found = texts.to_pylist()
            done = iter(self.batch([t for t in found if t is not None]))
            rows = [None if t is None else [dict(zip(("tok", "id", "start", "end"), x)) for x in next(done)] for t in found]
            return pa.array(rows, pa.list_(pa.struct([("tok", pa.string()), ("id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))

        def run(texts: pa.Array) -> pa.Array:
            return stepwise(some, texts)

        return F.arrow_udf(run, TOKEN_STRUCT)(_c(text))

    def ids(self, text) -> Column:
        return F.transform(self.tokens(text), lambda s: s.getField("id"))


def ids_of(tokens) -> Column:
    return F.transform(_c(tokens), lambda s: s.getField("id"))


# ---------------------------------------------------------------- T2-T8

def append_eos(ids, eos: int = EOS_ID) -> Column:
    """Append EOS unless the last id already is EOS (empty arrays get one)."""
    a = _c(ids)
    return F.when(F.try_element_at(a, F.lit(-1)) == F.lit(eos), a).otherwise(F.array_append(a, F.lit(eos)))


def trim(ids, n: int | None) -> Column:
    """First ``n`` ids; identity without a length."""
    a = _c(ids)
    return a if n is None else F.slice(a, 1, n)


def trim_append_eos(ids, n: int | None, eos: int = EOS_ID) -> Column:
    """T5: ``ids[:n-1] + [eos]`` with a length, else ``ids + [eos]`` (always appends)."""
    a = _c(ids)
    return F.array_append(F.slice(a, 1, n - 1) if n is not None else a, F.lit(eos))


def trim_pad(ids, n: int | None, pad: int = PAD_ID) -> Column:
    """Cut to ``n`` and right-pad with ``pad``; identity without a length."""
    a = _c(ids)
    if n is None:
        return a
    return F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def attention_mask(ids, n: int | None) -> Column:
    """``m`` ones then ``n - m`` zeros, ``m = min(size, n)``."""
    a = _c(ids)
    if n is None:
        return F.array_repeat(F.lit(1), F.size(a))
    m = F.least(F.size(a), F.lit(n))
    return F.concat(F.array_repeat(F.lit(1), m), F.array_repeat(F.lit(0), F.lit(n) - m))


def tokenize_features(df: DataFrame, features: dict, copy_pretokenized: bool = True,
                      with_eos: bool = False) -> DataFrame:
    """``features`` maps column → (tokenizer, add_eos).  Non-feature columns pass through."""
    cols = {}
    for k, (tok, add_eos) in features.items():
        if copy_pretokenized:
            cols[f"{k}_pretokenized"] = F.col(k)
        ids = tok.ids(F.col(k))
        cols[k] = append_eos(ids) if (with_eos and add_eos) else ids
    return df.withColumns(cols)


def _pad_and_mask(n: int, pad: int, with_mask: bool):
    def body(x):
        parts = [trim_pad(x, n, pad).alias("v")]
        if with_mask:
            parts.append(attention_mask(x, n).alias("m"))
        return F.struct(*parts)

    return body


def trim_pad_features(df: DataFrame, lengths: dict | None, pad_ids: dict | None = None,
                      with_mask: bool = True) -> DataFrame:
    """T6/T7/T8 over several columns; ``pad_ids`` gives a per-column pad id."""
    if not lengths:
        return df
    fields = []
    names = {}
    for k, n in lengths.items():
        if k not in df.columns:
            continue
        pad = (pad_ids or {}).get(k, PAD_ID)
        # each source array is evaluated once for both the padded ids and the mask
        fields.append(let(F.col(k), _pad_and_mask(n, pad, with_mask)).alias(f"_tp{len(fields)}"))
        names[k] = f"_tp{len(fields) - 1}"
    if not fields:
        return df
    # one-element explode: the padded structs become attributes (not re-inlined per field)
    t = df.select("*", F.explode(F.array(F.struct(*fields))).alias("_tp"))
    cols = {}
    for k, f in names.items():
        cols[k] = F.col(f"_tp.{f}.v")
        if with_mask:
            cols[f"{k}_attention_mask"] = F.col(f"_tp.{f}.m")
    return t.withColumns(cols).drop("_tp")
