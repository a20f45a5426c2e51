"""Prediction post-processing (P1-P6) as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.hof import let
from textloom.functions.tokens import EOS_ID, FIRST_WORD_ID

# Plain decimal or exponent number, optional sign and surrounding spaces, or nan/inf.
NUMERIC_REGEX = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|nan|inf|infinity)\s*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def argmax(logits) -> Column:
    """0-based index of the first maximum of the last axis."""
    a = _c(logits)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def cut_at_eos(ids, eos: int = EOS_ID) -> Column:
    """Ids before the first EOS; all of them if there is none."""
    a = _c(ids)
    p = F.array_position(a, F.lit(eos))
    return F.when(p == 0, a).otherwise(F.slice(a, F.lit(1), (p - 1).cast("int")))


def argmax_tokens(logits) -> Column:
    """P1 on token logits (array of arrays): one id per token."""
    return F.transform(_c(logits), argmax)


def decode(ids, words: Column, eos: int = EOS_ID) -> Column:
    """Cut at EOS, drop special and unknown ids, look each id up in the vocabulary, join by space.

    ``words`` is a column with the words in the order of their ids, an array bounded by the vocabulary's size;
    ``decode_columns`` adds it from the vocabulary.
    """
    return let(words, lambda w: F.array_join(F.transform(
        F.filter(cut_at_eos(ids, eos), lambda i: i >= FIRST_WORD_ID), lambda i: F.get(w, i - FIRST_WORD_ID)), " "))


def decode_columns(df: DataFrame, keys: list[str], words: Column, eos: int = EOS_ID) -> DataFrame:
    """The named id columns become text; the others pass through.

    ``words`` is ``TableVocab.word_list``: a scalar subquery, evaluated once per query; no job runs while the
    query is built.
    """
    found = [k for k in keys if k in df.columns]
    out = df.withColumn("_words", words)
    return out.withColumns({k: decode(F.col(k), F.col("_words"), eos) for k in found}).drop("_words")


def decode_float(text, default: float = -1.0) -> Column:
    """P5: text → double, ``default`` when it does not parse as a number."""
    t = F.lower(_c(text))
    ok = t.rlike(NUMERIC_REGEX)
    return F.when(ok, F.coalesce(F.trim(t).try_cast("double"), F.lit(default))).otherwise(F.lit(default))


def decode_label(text, names: list[str]) -> Column:
    """Index of the text in the label list, −1 when absent."""
    arr = F.array(*[F.lit(n) for n in names])
    return (F.array_position(arr, _c(text)) - 1).cast("int")
