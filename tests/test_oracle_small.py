"""Registered queries against their DuckDB oracles on the smallest driver tables."""

import math

import duckdb
import pytest

from conftest import SF_SMALL

TABLES = ["documents", "labels", "conversations", "embeddings", "events", "lineitem"]

# one or more per operator family; the full set runs in scripts/oracle_check.py
PICK = [
    "source_split_sizes", "split_slice_90", "epoch_shuffle_shards", "collate_batches", "model_columns", "rekey_columns",
    "map_batches", "pad_punct", "relation_prompt_spans", "qa_prompt", "token_offsets", "decode_text", "append_eos",
    "char_tags_to_spans", "token_tags_parallel", "doc_windows", "mention_augment_exclude", "bleu", "rouge_n",
    "spearman", "char_entity_f1", "mcc", "meter_average", "best_so_far_max", "concat_pool", "batch_score",
    "task_char_ner", "task_relation_tk_idx", "task_coref_span_prediction", "rouge_lsum", "rouge_bootstrap", "meter_batched_bleu", "meter_batched_rouge",
    "meter_batched_entities", "meter_batched_f1", "model_forward", "model_generate", "evaluate_encoder", "evaluate_generative", "stream_prepare",
    "prepared_table", "tokenize_eos", "collate_strict", "dependency_labels", "task_word_ner_split",
]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", PICK)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E

    got = _rows(E.queries()[name](spark, SF_SMALL).toPandas())
    want = _rows(con.execute(E.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_query_has_oracle_or_is_rows_only():
    import __spark_entry__ as E

    missing = set(E.queries()) - set(E.oracle_sql()) - set(E._llm()[0])
    assert missing == set()


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["id", "input_ids", "attention_mask", "labels", "mode"]
