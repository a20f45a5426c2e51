"""The stages of the corpus pipeline as they are wired: edge rows, empty tables, and the whole run."""

from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as CP
from textloom.session import read_table

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(r) for r in df.select(*CP.DOCUMENT_COLUMNS).collect())


@pytest.fixture(scope="module")
def docs(edge_docs):
    return edge_docs.select(*CP.DOCUMENT_COLUMNS)


@pytest.mark.parametrize("name", [n for n, _ in CP.STAGES])
def test_an_empty_table_stays_empty(spark, no_docs, name):
    out = dict(CP.STAGES)[name](spark, no_docs.select(*CP.DOCUMENT_COLUMNS), SF)
    assert out.collect() == []
    if name != "encoding":
        assert out.columns == CP.DOCUMENT_COLUMNS


def test_quality_filter_keeps_rows_as_they_are(spark, docs):
    out = CP.quality_filter(spark, docs, SF)
    assert out.columns == CP.DOCUMENT_COLUMNS and not rows(out) - rows(docs)


def test_lines_keep_one_row_per_row(spark, docs):
    out, before = CP.lines(spark, docs, SF).collect(), docs.collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in before)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    assert sum(r.text is None for r in out) == sum(r.text is None for r in before)


def test_near_dup_keeps_one_of_each_group(spark, docs):
    kept, before = CP.near_dup(spark, docs, SF).collect(), docs.collect()
    assert not Counter(map(tuple, kept)) - Counter(map(tuple, before))
    assert sum(r.doc_id is None for r in kept) == sum(r.doc_id is None for r in before)  # a row without an id has no group
    base = next(r.text for r in before if r.doc_id == 16)
    same = [r.doc_id for r in before if r.doc_id is not None and (r.text or "").lower() == base.lower()]
    assert len(set(same)) > 1 and len({r.doc_id for r in kept if r.doc_id in same}) <= 1
    assert {r.doc_id for r in before if not (r.text or "").split() and r.doc_id is not None} <= {r.doc_id for r in kept}  # no words, no links


def test_mixing_takes_rows_of_its_input(spark, docs):
    out = CP.mixing(spark, docs, SF)
    assert out.columns == CP.DOCUMENT_COLUMNS and not set(rows(out)) - set(rows(docs)) and max(rows(out).values()) <= 3 * max(rows(docs).values())
    assert rows(out) == rows(CP.mixing(spark, docs.repartition(2), SF))


def test_whole_run(spark):
    docs = read_table(spark, SF, "documents")
    state = docs
    for name, stage in CP.STAGES[:-1]:
        state = CP.materialise(stage(spark, state, SF), f"test-{name}")
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in state.collect())
    got = Counter((r.doc_id, r.n_tokens) for r in CP.run(spark, SF).collect())
    assert got == want and got and {i for i, _ in got} <= {r.doc_id for r in docs.collect()}
