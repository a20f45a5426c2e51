"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, source mixing, BPE round trip.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bpe import bpe
from textloom.llm.common import documents, materialise, read_table
from textloom.llm.line_dedup import line_dedup
from textloom.llm.mixing import emit, mix
from textloom.llm.near_dup import near_duplicates
from textloom.llm.quality import quality

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts.

    Rows stay as they are; repeated rows share their fate, null texts, sources and languages are scored like others. An
    empty table stays empty; labels without both classes reject nothing.
    """
    return quality(docs, read_table(spark, sf_dir, "labels")).filter("quality_keep").select(*DOCUMENT_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines (50 words or more) that stand earlier; ``n_chars`` follows the text.

    One row per row: null texts stay null (and have null ``n_chars``), a text whose lines all stand earlier becomes
    empty, an empty table stays empty.
    """
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 0.8 or more of their five-word shingles.

    The smallest id of a group stays, with all rows that have it. Documents without words or text and rows without an
    id have no group and stay; an empty table stays empty.
    """
    kept = near_duplicates(docs, k=5, percent=80).filter("kept").select("doc_id").distinct()
    nameless = docs.filter("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").unionByName(nameless).select(*DOCUMENT_COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the target weights takes it.

    Null sources are a source, texts without words are taken at the rate of their source; reruns agree; an empty table
    stays empty.
    """
    return emit(mix(docs), DOCUMENT_COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: number of tokens, digest of its ids and of the text decoded from them.

    Null text encodes to no ids; one row per row, an empty table gives an empty result.
    """
    return bpe(docs)


STAGES = [("quality", quality_filter), ("lines", lines), ("near_dup", near_dup), ("mixing", mixing), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned classification, near-duplicate search and tokenization have no SQL form; tests/llm has brute-force versions.
ORACLE_SQL = None
