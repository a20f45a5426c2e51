"""The task catalogue: every task shape of the reference, renamed, over the derived inputs.

Each task is a ``TaskSpec`` whose steps are the operators of this package.
Split variants (``*_split``) share every step with their base task and read a
source that is divided into splits: here a stable tenth of the ids each, of
which they prepare the validation split.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import tokens as K
from textloom.functions.hof import bind_column
from textloom.functions.post import argmax, argmax_tokens, cut_at_eos, decode_columns, decode_float, decode_label
from textloom.labels import (ACCEPTABILITY_CLASSES, CHAR_NER_IOB2, NE_IOB2, NE_TYPES, NE_WIDE_IOB2, NE_WIDE_TYPES, NLI_CLASSES,
                             RELATION_CLASSES, TOPIC_CLASSES, UTTERANCE_CLASSES)
from textloom.operators import metrics as M
from textloom.operators import rows as R
from textloom.operators import select as W
from textloom.operators import spans as N
from textloom.plans import fixtures as FX
from textloom.sources.reader import hash_split
from textloom.spec import FeatureSpec, TaskRegistry, TaskSpec

VOCAB = K.HashVocab()
GEN = {"inputs": FeatureSpec(VOCAB, add_eos=False), "targets": FeatureSpec(VOCAB, add_eos=True)}
ENC = {"inputs": FeatureSpec(VOCAB, add_eos=False)}
LENGTHS = {"inputs": 64, "targets": 16}
WINDOW, STRIDE = 40, 16


# ---------------------------------------------------------------- steps

def classify(keys: list[str], benchmark: str, names: list[str] | None = None, no_label_idx: int = 0,
             label: str = "label"):
    """S4 + S5: prompt into ``inputs``; target name (generative) or id into ``targets``."""
    def step(df: DataFrame) -> DataFrame:
        tgt = X.label_name(label, names) if names else X.label_id(label, no_label_idx)
        return df.withColumns({"inputs": X.classify_prompt(keys, benchmark), "targets": tgt})
    return step


def regression(mode: str, benchmark: str, keys: list[str]):
    def step(df: DataFrame) -> DataFrame:
        return df.withColumns({"inputs": X.classify_prompt(keys, benchmark),
                               "targets": X.regression_target("labels", mode, benchmark if mode == "string" else None)})
    return step


def relation(benchmark: str, names: list[str] | None = None):
    def step(df: DataFrame) -> DataFrame:
        tgt = X.label_name("label", names) if names else F.col("label")
        return df.withColumns({"inputs": X.relation_prompt("sentence", "subject_entity", "object_entity", benchmark),
                               "targets": tgt})
    return step


def relation_token_index(benchmark: str):
    """S10 + N8: prompt tokens and the first/last token of each moved entity."""
    prefix = len(f"{benchmark} text: ")

    def step(df: DataFrame) -> DataFrame:
        s, o = X.shifted_entities("subject_entity", "object_entity", prefix)
        d = df.withColumns({"inputs_pretokenized": X.relation_prompt("sentence", "subject_entity", "object_entity", benchmark)})
        d = bind_column(d.withColumns({"_s": s, "_o": o}), "_tk", VOCAB.tokens("inputs_pretokenized"))
        d = d.withColumn("entity_token_idx", N.entity_token_bounds("_tk", F.length("inputs_pretokenized"),
                                                                   [F.col("_s"), F.col("_o")]))
        return d.withColumns({"inputs": K.ids_of("_tk"), "targets": F.col("label")}).drop("_tk", "_s", "_o")
    return step


def generate(keys: list[str], prefix: str, target: str):
    def step(df: DataFrame) -> DataFrame:
        return df.withColumns({"inputs": X.generation_prompt(keys, prefix), "targets": F.col(target)})
    return step


def qa(benchmark: str, with_context: bool):
    def step(df: DataFrame) -> DataFrame:
        d = df.withColumn("answers", F.array("answer"))
        i, t = X.qa_prompt("question", "context" if with_context else None, benchmark, answers="answers",
                           impossible="is_impossible" if with_context else None)
        return d.withColumns({"inputs": i, "targets": t})
    return step


def tokenize(df: DataFrame, output_features: dict) -> DataFrame:
    """T1 over the output features present (copies the text to ``{k}_pretokenized``)."""
    feats = {k: (f.tokenizer, f.add_eos) for k, f in output_features.items()
             if k in df.columns and dict(df.dtypes)[k] == "string"}
    return K.tokenize_features(df, feats)


def append_eos(df: DataFrame, output_features: dict, sequence_length: dict | None) -> DataFrame:
    """T5: trim to n-1 and append EOS for features with ``add_eos``."""
    cols = {k: K.trim_append_eos(k, (sequence_length or {}).get(k)) for k, f in output_features.items()
            if f.add_eos and k in df.columns and dict(df.dtypes)[k].startswith("array")}
    return df.withColumns(cols) if cols else df


def pad(pad_ids: dict | None = None):
    def step(df: DataFrame, sequence_length: dict | None) -> DataFrame:
        lengths = {k: n for k, n in (sequence_length or {}).items()
                   if k in df.columns and dict(df.dtypes)[k].startswith("array")}
        return K.trim_pad_features(df, lengths, pad_ids)
    return step


def model_io(df: DataFrame) -> DataFrame:
    """Final rekey to the model's column names."""
    return R.rekey(df, {"input_ids": "inputs", "attention_mask": "inputs_attention_mask", "labels": "targets"})


def char_ner(df: DataFrame) -> DataFrame:
    """N3 + N6: character example → word tokens with IOB2 ids."""
    d = N.char_example(df)
    d = bind_column(d, "_tk", VOCAB.tokens("text"))
    return d.withColumns({
        "inputs_pretokenized": F.col("text"),
        "inputs": K.ids_of("_tk"),
        "targets": N.spans_to_token_tags("_tk", "NE", CHAR_NER_IOB2),
    }).drop("_tk")


def _word_tags(types: list[str], iob2_tags: list[str]):
    """Parallel span arrays with label ids → IOB2 ids per token."""
    def step(df: DataFrame) -> DataFrame:
        d = bind_column(df, "_tk", VOCAB.tokens("text"))
        spans = N.parallel_spans("ne_par", types)
        return d.withColumns({
            "inputs_pretokenized": F.col("text"),
            "inputs": K.ids_of("_tk"),
            "targets": N.spans_to_token_tags("_tk", spans, iob2_tags),
        }).drop("_tk")
    return step


word_ner = _word_tags(NE_TYPES, NE_IOB2)
word_ner_wide = _word_tags(NE_WIDE_TYPES, NE_WIDE_IOB2)


def coref_windows(df: DataFrame) -> DataFrame:
    return N.doc_windows(df.select("id", "text", "CR"), "id", "text", span_length=WINDOW, doc_stride=STRIDE, chains_col="CR")


def coref_extract(df: DataFrame) -> DataFrame:
    return N.mention_tags(df, "text").withColumn("inputs", F.col("text"))


def coref_predict(df: DataFrame) -> DataFrame:
    return N.mention_augment(df, "id", "text").withColumn("inputs", F.col("text"))


def _label_mod(k: int, col: str = "turn"):
    def step(df: DataFrame) -> DataFrame:
        return df.withColumn("label", (F.col(col) % k).cast("int"))
    return step


def _rename(mapping: dict):
    def step(df: DataFrame) -> DataFrame:
        return R.rekey(df, mapping)
    return step


# ---------------------------------------------------------------- scoring helpers

def _acc(df, group=()):
    return M.accuracy(df, "labels", "predictions", group=group)


def _em(df, group=()):
    return M.exact_match(df, "labels", "predictions", group=group)


def _mcc(df, group=()):
    return M.matthews(df, "labels", "predictions", group=group)


def _f1(df, group=()):
    return M.micro_f1_nonzero(df, "labels", "predictions", group=group)


def _tok_acc(df, group=()):
    """Padding does not count: the mask, where there is one, skips it."""
    mask = "attention_mask" if "attention_mask" in df.columns else None
    return M.token_accuracy_ragged(df, "labels", "predictions", mask=mask, group=group)


def _char_entities(df, group=()):
    """M13 where the scored rows carry the character views (``char_tags``, ``c2t``); else no row."""
    if not {"char_tags", "c2t"} <= set(df.columns):
        return None
    d = df.withColumn("_pc", M.token_tags_to_char_tags("predictions", "c2t", CHAR_NER_IOB2))
    return M.char_entity_f1(d, "char_tags", "_pc", CHAR_NER_IOB2, group=group)


def _argmax_post(df):
    """P1 over the last axis: one id per row, or per token for token logits."""
    if "logits" not in df.columns:
        return df
    per_token = dict(df.dtypes)["logits"].startswith("array<array")
    return df.withColumn("predictions", argmax_tokens("logits") if per_token else argmax("logits"))


def text_post(number: bool = False, names: list[str] | None = None):
    """P2-P6 for generated text: id arrays become text, then a number or the index of a class name.

    With ``words`` (a vocabulary's words in id order) the text is decoded (P4); without, the ids themselves are
    the words, which compares the same way.
    """
    def post(df: DataFrame, words=None) -> DataFrame:
        if "id" not in df.columns:
            df = df.withColumn("id", F.monotonically_increasing_id())
        arrays = [c for c in ("labels", "predictions") if dict(df.dtypes)[c].startswith("array")]
        if words is not None:
            df = decode_columns(df, arrays, words)
        else:
            df = df.withColumns({c: F.array_join(F.filter(cut_at_eos(c), lambda i: i >= K.FIRST_WORD_ID), " ") for c in arrays})
        if number:
            return df.withColumns({c: decode_float(c) for c in ("labels", "predictions")})
        if names:
            return df.withColumns({c: decode_label(c, names) for c in ("labels", "predictions")})
        return df
    return post


def _pearson(df, group=()):
    return M.pearson(df, "labels", "predictions", group=group)


def _spearman(df, group=()):
    return M.spearman(df, "labels", "predictions", group=group)


def _char_f1(df, group=()):
    return M.char_f1(df, "labels", "predictions", group=group)


def _bleu(df, group=()):
    return M.bleu(df, "labels", "predictions", group=group)


def _rouge(df, group=()):
    return M.rouge_n(df, "labels", "predictions", group=group).unionByName(M.rouge_lsum(df, "labels", "predictions", group=group))


# ---------------------------------------------------------------- catalogue

def _src(fn):
    return lambda spark, root: fn(spark, root)


def _scores_src(spark, root):
    return FX.scores(spark, root)


def validation_split(source):
    """The source cut to its validation split: ids whose hash falls into the last tenth."""
    return lambda spark, root: hash_split(source(spark, root), ["id"], 90, 100)


def build_catalogue() -> list[TaskSpec]:
    gen_tail = (tokenize, append_eos, pad(), model_io)
    enc_tail = (tokenize, pad(), model_io)
    T = []
    T.append(TaskSpec("topic_classify_gen", _src(FX.cls), (classify(["text"], "topic_classify", TOPIC_CLASSES),) + gen_tail,
                      GEN, postprocess=text_post(), metrics=(_em,), best=W.greater_is_best))
    T.append(TaskSpec("topic_classify", _src(FX.cls), (classify(["text"], "topic_classify", None, 7),) + enc_tail,
                      ENC, postprocess=_argmax_post, metrics=(_acc,), best=W.greater_is_best))
    pair_keys = ["premise", "hypothesis"]
    pair_src = _src(lambda s, r: FX.pairs(s, r).transform(_rename({"premise": "question", "hypothesis": "context"}))
                    .transform(_label_mod(3)))
    T.append(TaskSpec("pair_classify_gen", pair_src, (classify(pair_keys, "pair_classify", NLI_CLASSES),) + gen_tail,
                      GEN, postprocess=text_post(), metrics=(_em,), best=W.greater_is_best))
    T.append(TaskSpec("pair_classify", pair_src, (classify(pair_keys, "pair_classify", None, 0),) + enc_tail,
                      ENC, postprocess=_argmax_post, metrics=(_acc,), best=W.greater_is_best))
    sim_keys = ["sentence1", "sentence2"]
    sim_src = _src(lambda s, r: FX.scores(s, r).transform(_rename({"sentence1": "event_type", "sentence2": "props"})))
    T.append(TaskSpec("similarity_gen", sim_src, (regression("string", "similarity", sim_keys),) + gen_tail, GEN,
                      postprocess=text_post(number=True), metrics=(_pearson, _spearman), best=W.greater_is_best))
    T.append(TaskSpec("similarity_reg", sim_src, (regression("real", "similarity", sim_keys),) + enc_tail, ENC,
                      metrics=(_pearson, _spearman), best=W.greater_is_best))
    T.append(TaskSpec("similarity", sim_src, (regression("binary", "similarity", sim_keys),) + enc_tail, ENC,
                      metrics=(_pearson, _spearman), best=W.greater_is_best))
    T.append(TaskSpec("relation_gen", _src(FX.ents), (relation("relation", RELATION_CLASSES),) + gen_tail, GEN,
                      postprocess=text_post(), metrics=(_em,), best=W.greater_is_best))
    T.append(TaskSpec("relation", _src(FX.ents), (relation("relation"),) + enc_tail, ENC,
                      postprocess=_argmax_post, metrics=(_acc,), best=W.greater_is_best))
    T.append(TaskSpec("relation_tk_idx", _src(FX.ents), (relation_token_index("relation"), pad(), model_io), ENC,
                      postprocess=_argmax_post,
                      metrics=(_f1, _acc),
                      best=W.greater_is_best, model_columns=("input_ids", "attention_mask", "labels", "entity_token_idx")))
    T.append(TaskSpec("qa_gen", _src(FX.pairs), (qa("qa", True),) + gen_tail, GEN,
                      postprocess=text_post(), metrics=(_em, _char_f1), best=W.greater_is_best))
    T.append(TaskSpec("qa_gen_context_free", _src(FX.pairs), (qa("qa", False),) + gen_tail, GEN,
                      postprocess=text_post(), metrics=(_em, _char_f1), best=W.greater_is_best))
    o_char, o_word = CHAR_NER_IOB2.index("O"), NE_IOB2.index("O")
    T.append(TaskSpec("char_ner", _src(FX.chartags), (char_ner, pad({"targets": o_char}), model_io), ENC,
                      postprocess=_argmax_post, metrics=(_tok_acc, _char_entities), best=W.greater_is_best))
    T.append(TaskSpec("word_ner", _src(FX.spans), (word_ner, pad({"targets": o_word}), model_io), ENC,
                      postprocess=_argmax_post, metrics=(_tok_acc,), best=W.greater_is_best))
    T.append(TaskSpec("word_ner_wide", _src(FX.wide_spans), (word_ner_wide, pad({"targets": NE_WIDE_IOB2.index("O")}), model_io), ENC,
                      postprocess=_argmax_post, metrics=(_tok_acc,), best=W.greater_is_best))
    T.append(TaskSpec("summarize", _src(FX.pairs), (generate(["context"], "summarize:", "target"),) + gen_tail, GEN,
                      postprocess=text_post(), metrics=(_bleu, _rouge), best=W.greater_is_best))
    T.append(TaskSpec("summarize_topic", _src(FX.pairs), (generate(["context"], "summarize_topic:", "target"),) + gen_tail, GEN,
                      postprocess=text_post(), metrics=(_bleu, _rouge), best=W.greater_is_best))
    T.append(TaskSpec("acceptability_gen", _src(FX.cls),
                      (classify(["text"], "acceptability", ACCEPTABILITY_CLASSES),) + gen_tail, GEN,
                      postprocess=text_post(names=ACCEPTABILITY_CLASSES), metrics=(_mcc,), best=W.greater_is_best))
    T.append(TaskSpec("acceptability", _src(FX.cls), (classify(["text"], "acceptability", None, 0),) + enc_tail, ENC,
                      postprocess=_argmax_post, metrics=(_mcc,),
                      best=W.greater_is_best))
    T.append(TaskSpec("coref_span_extraction", _src(FX.mentions), (coref_windows, coref_extract, pad({"targets": 0}), model_io),
                      ENC, postprocess=_argmax_post, metrics=(_tok_acc,), best=W.greater_is_best))
    T.append(TaskSpec("coref_span_prediction", _src(FX.mentions), (coref_windows, coref_predict, pad({"targets": 0}), model_io),
                      ENC, postprocess=_argmax_post, metrics=(_tok_acc,), best=W.greater_is_best))
    intent_src = _src(lambda s, r: FX.text_table(s, r, "conversations").withColumn(
        "id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).transform(_label_mod(7)))
    T.append(TaskSpec("intent_gen", intent_src, (classify(["text"], "intent", UTTERANCE_CLASSES),) + gen_tail, GEN,
                      postprocess=text_post(), metrics=(_em,), best=W.greater_is_best))
    T.append(TaskSpec("intent", intent_src, (classify(["text"], "intent", None, 0),) + enc_tail, ENC,
                      postprocess=_argmax_post, metrics=(_acc,), best=W.greater_is_best))
    split = {"word_ner", "word_ner_wide", "summarize", "summarize_topic"}
    T.extend(replace(t, name=f"{t.name}_split", source=validation_split(t.source)) for t in list(T) if t.name in split)
    return T


def register_all() -> list[str]:
    for t in build_catalogue():
        if t.name not in TaskRegistry.names():
            TaskRegistry.add(t)
    return TaskRegistry.names()
