"""Queries for token arrays (T1-T9), vocabularies and prediction post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import post as P
from textloom.functions import tokens as K
from textloom.labels import CHAR_NER_IOB2
from textloom.plans import fixtures as FX
from textloom.plans import oracle_fixtures as O
from textloom.plans.registry import query
from textloom.session import read_table, text_table

CID = O.CID


def _txt(c):
    return F.array_join(c, " ")


# ---------------------------------------------------------------- T1 T9


@query("tokenize_ids", f"""
SELECT {CID} AS id, array_to_string({O.hash_ids('text')}, ' ') AS ids, len({O.hash_ids('text')})::INT AS n
FROM conversations""")
def tokenize_ids(spark, sf):
    c = text_table(spark, sf, "conversations")
    v = K.HashVocab()
    f = K.tokenize_features(c.withColumn("inputs", F.col("text")), {"inputs": (v, False)})
    return f.select(F.concat_ws(":", "conv_id", "turn").alias("id"), _txt("inputs").alias("ids"),
                    F.size("inputs").alias("n"))


@query("tokenize_eos", f"""
SELECT {CID} AS id, array_to_string(CASE WHEN ids[-1] = 1 THEN ids ELSE ids || [1] END, ' ') AS targets, array_to_string(ids, ' ') AS inputs,
       md5(text) AS pretokenized_md5
FROM (SELECT *, {O.hash_ids('text')} AS ids FROM conversations)""")
def tokenize_eos(spark, sf):
    """EOS behind the features that ask for it; the text stays beside the ids."""
    c = text_table(spark, sf, "conversations").withColumns({"inputs": F.col("text"), "targets": F.col("text")})
    f = K.tokenize_features(c, {"inputs": (K.HashVocab(), False), "targets": (K.HashVocab(), True)}, with_eos=True)
    return f.select(F.concat_ws(":", "conv_id", "turn").alias("id"), _txt("targets").alias("targets"), _txt("inputs").alias("inputs"),
                    F.md5("targets_pretokenized").alias("pretokenized_md5"))


@query("token_offsets", f"""
SELECT id, s.pos::INT AS pos, s.tok AS tok, s.tid AS tok_id, s.st AS tok_start, s.en AS tok_end FROM (
  SELECT {CID} AS id, unnest(list_transform(toks, lambda t, i: {{'pos': i - 1, 'tok': t.tok, 'tid': t.id,
                                                             'st': t.start, 'en': t."end"}})) AS s
  FROM {O.with_tokens('conversations')})""")
def token_offsets(spark, sf):
    c = text_table(spark, sf, "conversations")
    t = c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.posexplode(K.HashVocab().tokens("text")).alias("pos", "t"))
    return t.select("id", "pos", F.col("t.tok").alias("tok"), F.col("t.id").alias("tok_id"),
                    F.col("t.start").alias("tok_start"), F.col("t.end").alias("tok_end"))


@query("vocab_topk", f"""
SELECT tok, (row_number() OVER (ORDER BY count DESC, tok) + 2)::INT AS id, count FROM (
  SELECT tok, count(*) AS count FROM (SELECT unnest({O.words('text')}) AS tok FROM documents) GROUP BY tok
  ORDER BY count DESC, tok LIMIT 1000)""")
def vocab_topk(spark, sf):
    d = text_table(spark, sf, "documents")
    return K.TableVocab(1000).build(d, "text")


@query("vocab_encode", f"""
WITH v AS (SELECT tok, (row_number() OVER (ORDER BY count DESC, tok) + 2)::INT AS id FROM (
             SELECT tok, count(*) AS count FROM (SELECT unnest({O.words('text')}) AS tok FROM documents) GROUP BY tok
             ORDER BY count DESC, tok LIMIT 1000)),
     w AS (SELECT {CID} AS id, s.pos, s.tok FROM (
             SELECT conv_id, turn, unnest(list_transform({O.words('text')}, lambda x, i: {{'pos': i, 'tok': x}})) AS s
             FROM conversations))
SELECT w.id, string_agg(coalesce(v.id, 2)::VARCHAR, ' ' ORDER BY w.pos) AS ids, count(*)::INT AS n
FROM w LEFT JOIN v ON w.tok = v.tok GROUP BY w.id""")
def vocab_encode(spark, sf):
    """T1 with a table vocabulary: top-1000 words of ``documents``, applied to ``conversations``."""
    tv = K.TableVocab(1000)
    vocab = tv.build(text_table(spark, sf, "documents"), "text")
    c = text_table(spark, sf, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    enc = tv.encode(c, ["id"], "text", vocab)
    return enc.select("id", _txt("ids").alias("ids"), F.size("ids").alias("n"))


def _whitespace_md5_tokenizer(texts: list[str]):
    """A user tokenizer for the plug-in path: whitespace words with md5-prefix ids (same as HashVocab)."""
    import hashlib
    import re

    def word_id(w: str) -> int:
        return int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16) % 32000 + 3

    ids = {w: word_id(w) for w in set(re.findall(r"[^ \t\n\r]+", "\n".join(texts)))}
    return [[(m.group(0), ids[m.group(0)], m.start(), m.end()) for m in re.finditer(r"[^ \t\n\r]+", t)] for t in texts]


@query("plugin_tokenizer", f"""
SELECT id, array_to_string(list_transform(toks, lambda t: t.id), ' ') AS ids,
       array_to_string(list_transform(toks, lambda t: t.start), ' ') AS starts
FROM (SELECT {CID} AS id, * FROM {O.with_tokens('conversations')})""")
def plugin_tokenizer(spark, sf):
    c = text_table(spark, sf, "conversations")
    tk = K.ArrowTokenizer(_whitespace_md5_tokenizer).tokens("text")
    t = c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), tk.alias("tk"))
    return t.select("id", _txt(F.transform("tk", lambda s: s["id"])).alias("ids"),
                    _txt(F.transform("tk", lambda s: s["start"])).alias("starts"))


# ---------------------------------------------------------------- T2-T8

_EOS = O.EOS_IDS


@query("trim_ids", f"SELECT id, array_to_string(ids[1:16], ' ') AS ids FROM {_EOS}")
def trim_ids(spark, sf):
    e = FX.eos_ids(spark, sf)
    return e.select("id", _txt(K.trim("ids", 16)).alias("ids"))


@query("append_eos", f"""
SELECT id, array_to_string(CASE WHEN ids[-1] = 1 THEN ids ELSE ids || [1] END, ' ') AS ids,
       array_to_string(CASE WHEN _c[-1] = 1 THEN _c ELSE _c || [1] END, ' ') AS cut_ids
FROM (SELECT *, CASE WHEN list_position(ids, 1) IS NULL THEN ids ELSE ids[1:list_position(ids, 1)] END AS _c FROM {_EOS})""")
def append_eos(spark, sf):
    e = FX.eos_ids(spark, sf)
    p = F.array_position("ids", 1)
    cut = F.when(p == 0, F.col("ids")).otherwise(F.slice("ids", F.lit(1), p.cast("int")))
    return e.select("id", _txt(K.append_eos("ids")).alias("ids"), _txt(K.append_eos(cut)).alias("cut_ids"))


@query("trim_append_eos", f"SELECT id, array_to_string(ids[1:15] || [1], ' ') AS ids FROM {_EOS}")
def trim_append_eos(spark, sf):
    e = FX.eos_ids(spark, sf)
    return e.select("id", _txt(K.trim_append_eos("ids", 16)).alias("ids"))


def _pad_sql(expr: str, n: int, pad: int) -> str:
    return f"({expr}[1:{n}] || list_transform(range(greatest({n} - len({expr}), 0)), lambda x: {pad}))"


def _mask_sql(expr: str, n: int) -> str:
    return (f"(list_transform(range(least(len({expr}), {n})), lambda x: 1) || "
            f"list_transform(range({n} - least(len({expr}), {n})), lambda x: 0))")


@query("trim_pad", f"""
SELECT id, array_to_string({_pad_sql('ids', 32, 0)}, ' ') AS input_ids,
       array_to_string({_mask_sql('ids', 32)}, ' ') AS attention_mask FROM {_EOS}""")
def trim_pad(spark, sf):
    e = FX.eos_ids(spark, sf)
    f = K.trim_pad_features(e.withColumn("input_ids", F.col("ids")), {"input_ids": 32})
    return f.select("id", _txt("input_ids").alias("input_ids"), _txt("input_ids_attention_mask").alias("attention_mask"))


@query("trim_pad_labels", f"""
SELECT id, array_to_string({_pad_sql('labels', 64, CHAR_NER_IOB2.index('O'))}, ' ') AS labels,
       array_to_string({_mask_sql('labels', 64)}, ' ') AS labels_mask FROM {O.tagseq()}""")
def trim_pad_labels(spark, sf):
    t = FX.tagseq(spark, sf)
    f = K.trim_pad_features(t, {"labels": 64}, pad_ids={"labels": CHAR_NER_IOB2.index("O")})
    return f.select("id", _txt("labels").alias("labels"), _txt("labels_attention_mask").alias("labels_mask"))


@query("attention_mask", f"SELECT id, array_to_string({_mask_sql('ids', 128)}, ' ') AS mask FROM {_EOS}")
def attention_mask(spark, sf):
    e = FX.eos_ids(spark, sf)
    return e.select("id", _txt(K.attention_mask("ids", 128)).alias("mask"))


# ---------------------------------------------------------------- P1-P6


@query("argmax", f"SELECT id, (list_position(logits, list_max(logits)) - 1)::INT AS pred, labels FROM {O.LOGITS}")
def argmax(spark, sf):
    lg = FX.logits(spark, sf)
    return lg.select("id", P.argmax("logits").alias("pred"), "labels")


_CUT = "(CASE WHEN list_position(ids, 1) IS NULL THEN ids ELSE ids[1:list_position(ids, 1) - 1] END)"


@query("cut_eos", f"SELECT id, array_to_string({_CUT}, ' ') AS ids, len({_CUT})::INT AS n FROM {_EOS}")
def cut_eos(spark, sf):
    e = FX.eos_ids(spark, sf)
    c = P.cut_at_eos("ids")
    return e.select("id", _txt(c).alias("ids"), F.size(c).alias("n"))


_VOCAB = f"""(SELECT tok, (row_number() OVER (ORDER BY count DESC, tok) + 2)::INT AS id FROM (
  SELECT tok, count(*) AS count FROM (SELECT unnest({O.words('text')}) AS tok FROM conversations) GROUP BY tok
  ORDER BY count DESC, tok LIMIT 2000))"""


def _encoded(spark, sf):
    """Conversations encoded by their own top-2000 vocabulary, and the words of that vocabulary."""
    tv = K.TableVocab(2000)
    c = text_table(spark, sf, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    vocab = tv.build(c, "text")
    return tv.encode(c, ["id", "turn"], "text", vocab), tv.word_list(vocab)


@query("decode_text", f"""
WITH w AS (SELECT {CID} AS id, turn, s.pos, s.tok FROM (
             SELECT conv_id, turn, unnest(list_transform({O.words('text')}, lambda x, i: {{'pos': i, 'tok': x}})) AS s
             FROM conversations))
SELECT w.id, md5(coalesce(string_agg(v.tok, ' ' ORDER BY w.pos) FILTER (v.tok IS NOT NULL AND w.pos <= w.turn + 3), '')) AS text_md5,
       (count(v.tok) FILTER (w.pos <= w.turn + 3))::INT AS n_words
FROM w LEFT JOIN {_VOCAB} v ON w.tok = v.tok GROUP BY w.id""")
def decode_text(spark, sf):
    """P3 with one id per word: encode, put EOS after word turn + 3, decode back to the true words."""
    e, words = _encoded(spark, sf)
    k = (F.col("turn") + 3).cast("int")
    ids = F.concat(F.slice("ids", 1, k), F.array(F.lit(1)), F.slice("ids", k + 1, F.greatest(F.size("ids") - k, F.lit(0))))
    e = e.withColumn("ids", F.when(F.size("ids") >= k, ids).otherwise(F.col("ids")))
    e = e.withColumn("n_words", F.size(F.filter(P.cut_at_eos("ids"), lambda i: i >= 3)))
    return P.decode_columns(e, ["ids"], words).select("id", F.md5("ids").alias("text_md5"), "n_words")


@query("decode_columns", f"""
WITH w AS (SELECT {CID} AS id, s.pos, s.tok FROM (
             SELECT conv_id, turn, unnest(list_transform({O.words('text')}, lambda x, i: {{'pos': i, 'tok': x}})) AS s
             FROM conversations))
SELECT w.id, md5(coalesce(string_agg(v.tok, ' ' ORDER BY w.pos) FILTER (v.tok IS NOT NULL), '')) AS labels_md5,
       md5(coalesce(string_agg(v.tok, ' ' ORDER BY w.pos) FILTER (v.tok IS NOT NULL AND w.pos <= 5), '')) AS predictions_md5
FROM w LEFT JOIN {_VOCAB} v ON w.tok = v.tok GROUP BY w.id""")
def decode_columns(spark, sf):
    """Labels and predictions (the first five words) decoded, the id column left alone."""
    e, words = _encoded(spark, sf)
    e = e.select("id", F.col("ids").alias("labels"), F.slice("ids", 1, 5).alias("predictions"))
    d = P.decode_columns(e, ["labels", "predictions"], words)
    return d.select("id", F.md5("labels").alias("labels_md5"), F.md5("predictions").alias("predictions_md5"))


@query("argmax_tokens", f"""
SELECT id, array_to_string(list_transform(predictions, lambda p: CASE WHEN p > 5 THEN p ELSE 0 END), ' ') AS pred
FROM {O.tagseq()}""")
def argmax_tokens(spark, sf):
    """P1 on token logits: 1.5 on the tag if it is above 5, else all equal, so the first wins."""
    t = FX.tagseq(spark, sf)
    logits = F.transform("predictions", lambda p: F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.when((k == p) & (p > 5), 1.5).otherwise(0.0)))
    return t.select("id", _txt(P.argmax_tokens(logits)).alias("pred"))


_NUM = P.NUMERIC_REGEX


def _float_sql(x: str) -> str:
    return (f"(CASE WHEN regexp_matches(lower({x}), '{_NUM}') THEN coalesce(TRY_CAST(trim(lower({x})) AS DOUBLE), -1.0) "
            f"ELSE -1.0 END)")


@query("decode_float", f"""
SELECT event_id AS id, {_float_sql("regexp_extract(props, '[0-9]+', 0)")} AS f_num, {_float_sql('props')} AS f_raw,
       {_float_sql("printf('%.2f', value)")} AS f_value
FROM events""")
def decode_float(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"),
                    P.decode_float(F.regexp_extract("props", "[0-9]+", 0)).alias("f_num"),
                    P.decode_float("props").alias("f_raw"),
                    P.decode_float(F.format_string("%.2f", "value")).alias("f_value"))


@query("decode_label", """
SELECT doc_id, (coalesce(list_position(['en', 'fr', 'de'], lang), 0) - 1)::INT AS label FROM documents""")
def decode_label(spark, sf):
    d = text_table(spark, sf, "documents")
    return d.select("doc_id", P.decode_label("lang", ["en", "fr", "de"]).alias("label"))
