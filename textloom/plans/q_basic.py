"""Queries for sources, splits, sharding, row operators and text functions (A*, B*, S*)."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X
from textloom.functions.tokens import HashVocab, trim_pad, attention_mask, words
from textloom.labels import RELATION_CLASSES, TOPIC_CLASSES
from textloom.operators import rows as R
from textloom.plans import fixtures as FX
from textloom.plans import oracle_fixtures as O
from textloom.plans.registry import query
from textloom.session import ensure_checkpoint_dir, read_table, text_table
from textloom.sources.prepared import prepare_once
from textloom.sources import reader as S
from textloom.sources import sharding as SH

CID = O.CID

# ---------------------------------------------------------------- A1 A2 A4


@query("source_split_sizes", """
SELECT CASE source WHEN 'src0' THEN 'train' WHEN 'src1' THEN 'validation' ELSE source END AS split,
       count(*)::BIGINT AS num_examples
FROM documents GROUP BY 1""")
def source_split_sizes(spark, sf):
    spec = S.SourceSpec("documents.parquet", split_col="source", aliases={"train": "src0", "validation": "src1"})
    return spec.sizes(spark, root=sf)


# ---------------------------------------------------------------- A3

_SLICE = """
WITH t AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, lang FROM t WHERE {cond}"""
_BOUND90 = "floor((n * 90000 * 2 + 100000) / 200000)"


@query("split_slice_90", _SLICE.format(cond=f"idx < {_BOUND90}"))
def split_slice_90(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    return S.slice_split(d, ["doc_id"], None, 90)


@query("split_slice_rest", _SLICE.format(cond=f"idx >= {_BOUND90}"))
def split_slice_rest(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    return S.slice_split(d, ["doc_id"], 90, None)


@query("split_hash", """
SELECT doc_id, b AS bucket FROM (
  SELECT doc_id, (('0x' || substr(md5(chr(1) || doc_id::VARCHAR), 1, 8))::BIGINT % 100)::INT AS b FROM documents)
WHERE b < 80""")
def split_hash(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return S.hash_split(d, ["doc_id"], 0, 80).select("doc_id", S.hash_bucket(["doc_id"]).alias("bucket"))


# ---------------------------------------------------------------- A9-A13

_SHARD_SQL = """
WITH k AS (SELECT doc_id, ('0x' || substr(md5('0:1:' || doc_id::VARCHAR), 1, 15))::BIGINT AS ek FROM documents),
     i AS (SELECT doc_id, row_number() OVER (ORDER BY ek, doc_id) - 1 AS g FROM k)
SELECT doc_id, (g % 4)::INT AS shard, (g // 4)::BIGINT AS pos, ((g // 4) // 32)::BIGINT AS batch FROM i"""


@query("epoch_shuffle_shards", _SHARD_SQL)
def epoch_shuffle_shards(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return SH.assign_shards(d, ["doc_id"], epoch=1, world_size=4, batch_size=32)


@query("collate_batches", f"""
WITH k AS (SELECT id, labels, ('0x' || substr(md5('0:0:' || id::VARCHAR), 1, 15))::BIGINT AS ek FROM {O.LOGITS}),
     i AS (SELECT id, labels, row_number() OVER (ORDER BY ek, id) - 1 AS g FROM k),
     s AS (SELECT id, labels, (g % 2)::INT AS shard, g // 2 AS pos, (g // 2) // 8 AS batch FROM i)
SELECT shard, batch::BIGINT AS batch, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids,
       string_agg(labels::VARCHAR, ' ' ORDER BY pos) AS labels, count(*)::INT AS n
FROM s GROUP BY shard, batch""")
def collate_batches(spark, sf):
    lg = FX.logits(spark, sf).select("id", "labels")
    sh = SH.assign_shards(lg, ["id"], epoch=0, world_size=2, batch_size=8)
    c = SH.collate(sh, ["shard", "batch"], "pos", ["id", "labels"], strict=True)
    return c.select("shard", "batch", F.array_join("id", " ").alias("ids"), F.array_join("labels", " ").alias("labels"),
                    F.size("id").alias("n"))


@query("collate_strict", f"""
WITH k AS (SELECT id, logits, labels, ('0x' || substr(md5('0:2:' || id::VARCHAR), 1, 15))::BIGINT AS ek FROM {O.LOGITS}),
     i AS (SELECT *, row_number() OVER (ORDER BY ek, id) - 1 AS g FROM k),
     s AS (SELECT *, (g % 2)::INT AS shard, g // 2 AS pos, (g // 2) // 8 AS batch FROM i)
SELECT shard, batch::BIGINT AS batch, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids,
       round(sum(list_sum(logits)), 4) AS total, min(len(logits))::INT AS width, count(*)::INT AS n
FROM s GROUP BY shard, batch""")
def collate_strict(spark, sf):
    """The vectors of a batch must have one length, which the collation checks."""
    sh = SH.assign_shards(FX.logits(spark, sf), ["id"], epoch=2, world_size=2, batch_size=8)
    c = SH.collate(sh, ["shard", "batch"], "pos", ["id", "logits"], strict=True)
    total = F.aggregate("logits", F.lit(0.0), lambda acc, v: acc + F.aggregate(v, F.lit(0.0), lambda a, x: a + x))
    return c.select("shard", "batch", F.array_join("id", " ").alias("ids"), F.round(total, 4).alias("total"),
                    F.size(F.get("logits", 0)).alias("width"), F.size("id").alias("n"))


# ---------------------------------------------------------------- A6 A7 A8 B6

def _prepare(df, seq_len: int = 64):
    """Minimal classification chain: prompt → tokenize → trim/pad + mask (the flagship slice)."""
    v = HashVocab()

    def prompt(d):
        return d.withColumn("inputs", X.classify_prompt(["text"], benchmark="topic_classify"))

    def tokenize(d):
        return d.withColumn("inputs", v.ids(F.col("inputs")))

    def pad(d, sequence_length):
        n = sequence_length["inputs"]
        return d.withColumns({"input_ids": trim_pad("inputs", n), "attention_mask": attention_mask("inputs", n)})

    def labels(d):
        return R.rekey(d, {"labels": "label"})

    return R.chain(df, [prompt, tokenize, pad, labels], sequence_length={"inputs": seq_len})


def _prepared_sql(seq_len: int = 64) -> str:
    ids = O.hash_ids("concat_ws(' ', 'topic_classify', 'text: ' || text)")
    return f"""(SELECT id, lang, label AS labels, _ids[1:{seq_len}] || list_transform(range(greatest({seq_len} - len(_ids), 0)), lambda x: 0) AS input_ids,
       list_transform(range(least(len(_ids), {seq_len})), lambda x: 1) || list_transform(range({seq_len} - least(len(_ids), {seq_len})), lambda x: 0) AS attention_mask
  FROM (SELECT *, {ids} AS _ids FROM {O.CLS}))"""


@query("model_columns", f"""
SELECT id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(attention_mask, ' ') AS attention_mask,
       labels, 'forward' AS mode FROM {_prepared_sql()}""")
def model_columns(spark, sf):
    p = _prepare(FX.cls(spark, sf))
    m = S.model_columns(p, ["id", "input_ids", "attention_mask", "labels"], constants={"mode": "forward"})
    return m.select("id", F.array_join("input_ids", " ").alias("input_ids"),
                    F.array_join("attention_mask", " ").alias("attention_mask"), "labels", "mode")


@query("chain_prepare", f"""
SELECT id, md5(array_to_string(input_ids, ' ')) AS ids_md5, list_sum(attention_mask)::BIGINT AS n_tokens, labels
FROM {_prepared_sql()}""")
def chain_prepare(spark, sf):
    p = _prepare(FX.cls(spark, sf))
    return p.select("id", F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_tokens"),
                    "labels")


@query("prepared_table", f"""
SELECT lang AS split, count(*)::BIGINT AS num_examples, sum(list_sum(attention_mask))::BIGINT AS n_tokens
FROM {_prepared_sql()} GROUP BY lang""")
def prepared_table(spark, sf):
    p = _prepare(FX.cls(spark, sf)).select("id", "input_ids", "attention_mask", "labels", F.col("lang").alias("split"))
    root = ensure_checkpoint_dir(spark)
    back = prepare_once(p, os.path.join(root, "prepared", "topic_classify"))
    return back.groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("num_examples"),
        F.sum(F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)).cast("bigint").alias("n_tokens"))


# ---------------------------------------------------------------- B1-B5


@query("rekey_columns", """
SELECT doc_id, md5(text) AS inputs_md5, lang AS targets, '' AS empty, source AS text, md5(text) AS source_md5
FROM documents""")
def rekey_columns(spark, sf):
    d = text_table(spark, sf, "documents")
    r = R.rekey(d, {"inputs": "text", "targets": "lang", "empty": None, "text": "source", "source": "text"})
    return r.select("doc_id", F.md5("inputs").alias("inputs_md5"), "targets", "empty", "text",
                    F.md5("source").alias("source_md5"))


@R.map_rows
def _word_count(df):
    return {"n_words": F.size(words(F.col("text")))}


@query("map_rows", f"SELECT doc_id, len({O.words('text')})::INT AS n_words FROM documents")
def map_rows(spark, sf):
    return _word_count(text_table(spark, sf, "documents")).select("doc_id", "n_words")


def _lines(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = pdf["text"].str.split("\n")
    out = pd.DataFrame({"doc_id": pdf["doc_id"], "lines": parts}).explode("lines")
    out["line_no"] = out.groupby(level=0).cumcount()
    out["line_chars"] = out["lines"].str.len()
    return out[["doc_id", "line_no", "line_chars"]].astype("int64")


@query("map_batches", """
SELECT doc_id, s.i::BIGINT AS line_no, s.n::BIGINT AS line_chars FROM (
  SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i - 1, 'n': length(x)})) AS s
  FROM documents)""")
def map_batches(spark, sf):
    d = text_table(spark, sf, "documents").select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("line_no", T.LongType()),
                           T.StructField("line_chars", T.LongType())])
    return R.map_batches(d, _lines, schema)


def _kchars(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(kchars=pdf["n_chars"] // 1000)


@query("map_batches_drop", "SELECT doc_id, lang, source, n_chars, n_chars // 1000 AS kchars FROM documents")
def map_batches_drop(spark, sf):
    d = text_table(spark, sf, "documents")
    schema = "doc_id long, lang string, source string, n_chars long, kchars long"
    return R.map_batches(d, _kchars, schema, remove_columns=["text"], batch_size=100)


@query("filter_rows", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 1000 AND lang = 'en'")
def filter_rows(spark, sf):
    d = text_table(spark, sf, "documents")
    return R.filter_rows(d, (F.col("n_chars") > 1000) & (F.col("lang") == "en")).select("doc_id", "n_chars")


# ---------------------------------------------------------------- S1-S3


@query("collapse_space", f"""
SELECT doc_id, md5({O.collapse('text')}) AS h, length({O.collapse('text')})::INT AS n FROM documents""")
def collapse_space(spark, sf):
    d = text_table(spark, sf, "documents")
    c = X.collapse_space("text")
    return d.select("doc_id", F.md5(c).alias("h"), F.length(c).alias("n"))


@query("join_collapse", f"""
SELECT doc_id, md5({O.collapse("concat_ws(' | ', source, lang, text)")}) AS h FROM documents""")
def join_collapse(spark, sf):
    d = text_table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.join_collapse(["source", "lang", "text"], sep=" | ")).alias("h"))


@query("pad_punct", f"""
SELECT doc_id, md5({O.pad_punct('text')}) AS h, length({O.pad_punct('text')})::INT AS n FROM documents""")
def pad_punct(spark, sf):
    d = text_table(spark, sf, "documents")
    p = X.pad_punctuation("text")
    return d.select("doc_id", F.md5(p).alias("h"), F.length(p).alias("n"))


# ---------------------------------------------------------------- S4 S5 L1

_TOPIC = O.sql_list(TOPIC_CLASSES)


@query("classify_prompt", f"""
SELECT id, md5(concat_ws(' ', 'topic_classify', 'text: ' || text)) AS prompt_md5,
       CASE WHEN label >= 0 THEN coalesce({_TOPIC}[label + 1], '<unk>') ELSE '<unk>' END AS target_name,
       CASE WHEN label >= 0 THEN label ELSE 7 END AS target_id
FROM {O.CLS}""")
def classify_prompt(spark, sf):
    c = FX.cls(spark, sf)
    return c.select("id", F.md5(X.classify_prompt(["text"], benchmark="topic_classify")).alias("prompt_md5"),
                    X.label_name("label", TOPIC_CLASSES).alias("target_name"),
                    X.label_id("label", 7).alias("target_id"))


@query("label_names", f"""
WITH dict AS (SELECT (i - 1)::INT AS label_id, {_TOPIC}[i] AS label_name FROM range(1, {len(TOPIC_CLASSES) + 1}) t(i))
SELECT c.id, d.label_name, coalesce(d2.label_id, -1) AS label_back
FROM {O.CLS} c LEFT JOIN dict d ON c.label = d.label_id LEFT JOIN dict d2 ON d.label_name = d2.label_name""")
def label_names(spark, sf):
    c = FX.cls(spark, sf)
    d = spark.createDataFrame([(i, n) for i, n in enumerate(TOPIC_CLASSES)], "label_id int, label_name string")
    # the dictionary is a fixed list: broadcasting it is bounded by construction
    j = c.join(F.broadcast(d), c.label == d.label_id, "left").select("id", "label_name")
    back = j.join(F.broadcast(d.withColumnRenamed("label_id", "label_back")), "label_name", "left")
    return back.select("id", "label_name", F.coalesce("label_back", F.lit(-1)).alias("label_back"))


# ---------------------------------------------------------------- S6


@query("regression_prompt", f"""
SELECT id, concat_ws(' ', 'similarity', printf('%.1f', label)) AS target_str, real_label, binary_label
FROM {O.SCORES}""")
def regression_prompt(spark, sf):
    s = FX.scores(spark, sf)
    return s.select("id", X.regression_target("labels", "string", benchmark="similarity").alias("target_str"),
                    X.regression_target("labels", "real").alias("real_label"),
                    X.regression_target("labels", "binary").alias("binary_label"))


# ---------------------------------------------------------------- S7-S10

def _mark_sql(t: str, w: str, s: str, m: str) -> str:
    return (f"(CASE WHEN substr({t}, {s} + 1, length({w})) = {w} THEN substr({t}, 1, {s}) || '{m}' || {w} || '{m}' "
            f"|| substr({t}, {s} + length({w}) + 1) ELSE {t} END)")


def _ents_both_sql() -> str:
    return f"(SELECT *, 0 AS variant FROM {O.ents(False)} UNION ALL SELECT *, 1 AS variant FROM {O.ents(True)})"


def _ents_both(spark, sf):
    return FX.ents(spark, sf).withColumn("variant", F.lit(0)).unionByName(
        FX.ents(spark, sf, swap=True).withColumn("variant", F.lit(1)))


def _marked_sql() -> str:
    s1 = _mark_sql("sentence", "subject_entity.word", "subject_entity.start_idx", "*")
    ostart = ("(CASE WHEN subject_entity.start_idx < object_entity.start_idx THEN object_entity.start_idx + 2 "
              "ELSE object_entity.start_idx END)")
    return _mark_sql(s1, "object_entity.word", ostart, "#")


@query("mark_entities", f"""
SELECT id, variant, md5({_mark_sql('sentence', 'subject_entity.word', 'subject_entity.start_idx', '*')}) AS marked_md5
FROM {_ents_both_sql()}""")
def mark_entities(spark, sf):
    e = _ents_both(spark, sf)
    m = X.mark_entity("sentence", F.col("subject_entity.word"), F.col("subject_entity.start_idx"), "*")
    return e.select("id", "variant", F.md5(m).alias("marked_md5"))


_REL = O.sql_list(RELATION_CLASSES)


@query("relation_prompt", f"""
SELECT id, variant, md5(concat_ws(' ', 'relation', 'text: ' || {_marked_sql()})) AS prompt_md5,
       CASE WHEN label >= 0 THEN coalesce({_REL}[label + 1], '<unk>') ELSE '<unk>' END AS target
FROM {_ents_both_sql()}""")
def relation_prompt(spark, sf):
    e = _ents_both(spark, sf)
    p = X.relation_prompt("sentence", "subject_entity", "object_entity", benchmark="relation")
    return e.select("id", "variant", F.md5(p).alias("prompt_md5"),
                    X.label_name("label", RELATION_CLASSES).alias("target"))


_PREFIX = len("relation text: ")


@query("relation_prompt_spans", f"""
SELECT id, variant,
  coalesce((subject_entity.start_idx + CASE WHEN object_entity.start_idx <= subject_entity.start_idx THEN 2 ELSE 0 END + {_PREFIX})::INT, -1) AS s_start,
  coalesce((subject_entity.end_idx + 2 + CASE WHEN object_entity.start_idx <= subject_entity.start_idx THEN 2 ELSE 0 END + {_PREFIX})::INT, -1) AS s_end,
  coalesce((object_entity.start_idx + CASE WHEN subject_entity.start_idx < object_entity.start_idx THEN 2 ELSE 0 END + {_PREFIX})::INT, -1) AS o_start,
  coalesce((object_entity.end_idx + 2 + CASE WHEN subject_entity.start_idx < object_entity.start_idx THEN 2 ELSE 0 END + {_PREFIX})::INT, -1) AS o_end,
  substr('relation text: ' || {_marked_sql()},
         subject_entity.start_idx + CASE WHEN object_entity.start_idx <= subject_entity.start_idx THEN 2 ELSE 0 END + {_PREFIX} + 1,
         length(subject_entity.word) + 2) AS s_text
FROM {_ents_both_sql()}""")
def relation_prompt_spans(spark, sf):
    e = _ents_both(spark, sf)
    s, o = X.shifted_entities("subject_entity", "object_entity", _PREFIX)
    p = X.relation_prompt("sentence", "subject_entity", "object_entity", benchmark="relation")
    return e.select("id", "variant", s.alias("s"), o.alias("o"), p.alias("p")).select(
        "id", "variant", *[F.coalesce(F.col(f"{e}.{f}"), F.lit(-1)).alias(n) for e, f, n in [
            ("s", "start_idx", "s_start"), ("s", "end_idx", "s_end"), ("o", "start_idx", "o_start"), ("o", "end_idx", "o_end")]],
        F.substring("p", F.col("s.start_idx") + 1, F.length("s.word") + 2).alias("s_text"))


# ---------------------------------------------------------------- S11-S13


@query("generate_prompt", f"SELECT id, md5(concat_ws(' ', 'summarize:', context)) AS prompt_md5, target FROM {O.PAIRS}")
def generate_prompt(spark, sf):
    p = FX.pairs(spark, sf)
    return p.select("id", F.md5(X.generation_prompt(["context"], prefix="summarize:")).alias("prompt_md5"), "target")


@query("template_fill", f"""
SELECT id, md5('pair_nli premise: ' || question || ' hypothesis: ' || context) AS filled_md5 FROM {O.PAIRS}""")
def template_fill(spark, sf):
    p = FX.pairs(spark, sf)
    return p.select("id", F.md5(X.template_fill("pair_nli premise: {question} hypothesis: {context}",
                                                ["question", "context"])).alias("filled_md5"))


@query("qa_prompt", f"""
SELECT id, md5({O.collapse("concat_ws(' ', 'qa', 'question:', " + O.pad_punct('question') + ", 'context:', " + O.pad_punct('context') + ")")}) AS inputs_md5,
       CASE WHEN is_impossible THEN 'impossible' ELSE {O.pad_punct('answer')} END AS targets
FROM {O.PAIRS}""")
def qa_prompt(spark, sf):
    p = FX.pairs(spark, sf).withColumn("answers", F.array("answer"))
    i, t = X.qa_prompt("question", "context", "qa", answers="answers", impossible="is_impossible", pad_punct=True)
    return p.select("id", F.md5(i).alias("inputs_md5"), t.alias("targets"))


@query("qa_prompt_context_free", f"""
SELECT id, md5({O.collapse("concat_ws(' ', 'qa', 'trivia question:', question)")}) AS inputs_md5, answer AS targets
FROM {O.PAIRS}""")
def qa_prompt_context_free(spark, sf):
    p = FX.pairs(spark, sf).withColumn("answers", F.array("answer"))
    i, t = X.qa_prompt("question", None, "qa", answers="answers")
    return p.select("id", F.md5(i).alias("inputs_md5"), t.alias("targets"))
