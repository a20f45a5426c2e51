"""One registered query per task shape: the prepared model table of each task."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.labels import (ACCEPTABILITY_CLASSES, CHAR_NER_IOB2, NE_IOB2, NE_TYPES, NE_WIDE_IOB2, NE_WIDE_TYPES, NLI_CLASSES,
                             RELATION_CLASSES, TOPIC_CLASSES, UTTERANCE_CLASSES)
from textloom.plans import oracle_fixtures as O
from textloom.plans import q_basic as QB
from textloom.plans import q_spans as QS
from textloom.plans.registry import ORACLE, query
from textloom.plans.tasks import build_catalogue

_TASKS = {t.name: t for t in build_catalogue()}
GEN_LEN = {"inputs": 64, "targets": 16}
TAG_LEN = {"inputs": 64, "targets": 64}


def _arr(c):
    return F.array_join(c, " ")


def _spark_task(name: str, lengths: dict, label_kind: str):
    def run(spark, sf):
        df = _TASKS[name].prepare(spark, sf, lengths, all_columns=True)
        if label_kind == "array":
            lab = _arr("labels")
        elif label_kind == "double":
            lab = F.round(F.col("labels").cast("double"), 6)
        else:
            lab = F.col("labels").cast("int")
        return df.select(F.col("id").cast("string").alias("id"), _arr("input_ids").alias("input_ids"),
                         _arr("attention_mask").alias("attention_mask"), lab.alias("labels"))
    return run


# ---------------------------------------------------------------- SQL builders

def _names(names, x):
    return f"(CASE WHEN {x} >= 0 THEN coalesce({O.sql_list(names)}[{x} + 1], '<unk>') ELSE '<unk>' END)"


def _pad(e, n, p=0):
    return f"({e}[1:{n}] || list_transform(range(greatest({n} - len({e}), 0)), lambda x: {p}))"


def _mask(e, n):
    return (f"(list_transform(range(least(len({e}), {n})), lambda x: 1) || "
            f"list_transform(range({n} - least(len({e}), {n})), lambda x: 0))")


def _task_sql(src: str, prompt: str, label: str, label_kind: str, n_in: int = 64, n_t: int = 16) -> str:
    ids = O.hash_ids(prompt)
    if label_kind == "array":
        t = O.hash_ids(label)
        lab = f"array_to_string({_pad(f'({t}[1:{n_t - 1}] || [1])', n_t)}, ' ')"
    elif label_kind == "double":
        lab = f"round(({label})::DOUBLE, 6)"
    else:
        lab = f"({label})::INT"
    return f"""SELECT id::VARCHAR AS id, array_to_string({_pad(ids, n_in)}, ' ') AS input_ids,
       array_to_string({_mask(ids, n_in)}, ' ') AS attention_mask, {lab} AS labels FROM {src}"""


def _prompt(benchmark: str, keys: list[str], cols: list[str]) -> str:
    parts = ", ".join(f"'{k}: ' || {c}" for k, c in zip(keys, cols))
    return f"concat_ws(' ', '{benchmark}', {parts})"


_PAIRS3 = f"(SELECT *, (turn % 3)::INT AS label FROM {O.PAIRS})"
_INTENT = f"(SELECT {O.CID} AS id, text, (turn % 7)::INT AS label FROM conversations)"

_SIMPLE = {
    "topic_classify_gen": (O.CLS, _prompt("topic_classify", ["text"], ["text"]), _names(TOPIC_CLASSES, "label"), "array"),
    "topic_classify": (O.CLS, _prompt("topic_classify", ["text"], ["text"]), "CASE WHEN label >= 0 THEN label ELSE 7 END", "int"),
    "pair_classify_gen": (_PAIRS3, _prompt("pair_classify", ["premise", "hypothesis"], ["question", "context"]),
                          _names(NLI_CLASSES, "label"), "array"),
    "pair_classify": (_PAIRS3, _prompt("pair_classify", ["premise", "hypothesis"], ["question", "context"]),
                      "CASE WHEN label >= 0 THEN label ELSE 0 END", "int"),
    "similarity_gen": (O.SCORES, _prompt("similarity", ["sentence1", "sentence2"], ["event_type", "props"]),
                       "concat_ws(' ', 'similarity', printf('%.1f', label))", "array"),
    "similarity_reg": (O.SCORES, _prompt("similarity", ["sentence1", "sentence2"], ["event_type", "props"]), "real_label", "double"),
    "similarity": (O.SCORES, _prompt("similarity", ["sentence1", "sentence2"], ["event_type", "props"]), "binary_label", "int"),
    "summarize_topic": (O.PAIRS, "concat_ws(' ', 'summarize_topic:', context)", "target", "array"),
    "summarize": (O.PAIRS, "concat_ws(' ', 'summarize:', context)", "target", "array"),
    "acceptability_gen": (O.CLS, _prompt("acceptability", ["text"], ["text"]), _names(ACCEPTABILITY_CLASSES, "label"), "array"),
    "acceptability": (O.CLS, _prompt("acceptability", ["text"], ["text"]), "CASE WHEN label >= 0 THEN label ELSE 0 END", "int"),
    "intent_gen": (_INTENT, _prompt("intent", ["text"], ["text"]), _names(UTTERANCE_CLASSES, "label"), "array"),
    "intent": (_INTENT, _prompt("intent", ["text"], ["text"]), "CASE WHEN label >= 0 THEN label ELSE 0 END", "int"),
}

for _name, (_src, _p, _l, _kind) in _SIMPLE.items():
    query(f"task_{_name}", _task_sql(_src, _p, _l, _kind))(_spark_task(_name, GEN_LEN, _kind))

# relation family: the marked prompt of S9
_ENTS = QB._ents_both_sql()
_REL_PROMPT = f"concat_ws(' ', 'relation', 'text: ' || {QB._marked_sql()})"
query("task_relation_gen", _task_sql(f"(SELECT * FROM {_ENTS} WHERE variant = 0)", _REL_PROMPT,
                                     _names(RELATION_CLASSES, "label"), "array"))(_spark_task("relation_gen", GEN_LEN, "array"))
query("task_relation", _task_sql(f"(SELECT * FROM {_ENTS} WHERE variant = 0)", _REL_PROMPT, "label", "int"))(
    _spark_task("relation", GEN_LEN, "int"))

# question answering
_QA = f"concat_ws(' ', 'qa', 'question:', question, 'context:', context)"
query("task_qa_gen", _task_sql(O.PAIRS, O.collapse(_QA), "CASE WHEN is_impossible THEN 'impossible' ELSE answer END",
                               "array"))(_spark_task("qa_gen", GEN_LEN, "array"))
query("task_qa_gen_context_free", _task_sql(O.PAIRS, O.collapse("concat_ws(' ', 'qa', 'trivia question:', question)"),
                                            "answer", "array"))(_spark_task("qa_gen_context_free", GEN_LEN, "array"))


# relation with entity token indexes (S10 + N8)
def _rel_idx_sql() -> str:
    pre = len("relation text: ")
    first = "subject_entity.start_idx < object_entity.start_idx"
    s_st = f"(subject_entity.start_idx + CASE WHEN object_entity.start_idx <= subject_entity.start_idx THEN 2 ELSE 0 END + {pre})"
    s_en = f"(subject_entity.end_idx + 2 + CASE WHEN object_entity.start_idx <= subject_entity.start_idx THEN 2 ELSE 0 END + {pre})"
    o_st = f"(object_entity.start_idx + CASE WHEN {first} THEN 2 ELSE 0 END + {pre})"
    o_en = f"(object_entity.end_idx + 2 + CASE WHEN {first} THEN 2 ELSE 0 END + {pre})"
    src = f"(SELECT id, label, {_REL_PROMPT} AS p, {s_st} AS s_st, {s_en} AS s_en, {o_st} AS o_st, {o_en} AS o_en FROM {_ENTS} WHERE variant = 0)"

    def b(st, en, agg):
        idx = f'list_filter(list_transform(toks, lambda t, i: CASE WHEN t.start <= {en} AND t."end" > {st} THEN i - 1 END), lambda x: x IS NOT NULL)'
        return f"coalesce({agg}({idx}), -1)::INT"

    ids = "list_transform(toks, lambda t: t.id)"
    return f"""SELECT id, array_to_string({_pad(ids, 64)}, ' ') AS input_ids, array_to_string({_mask(ids, 64)}, ' ') AS attention_mask,
       label AS labels, {b('s_st', 's_en', 'list_min')} AS s_first, {b('s_st', 's_en', 'list_max')} AS s_last,
       {b('o_st', 'o_en', 'list_min')} AS o_first, {b('o_st', 'o_en', 'list_max')} AS o_last
FROM {O.with_tokens(src, 'p')}"""


@query("task_relation_tk_idx", _rel_idx_sql())
def task_relation_tk_idx(spark, sf):
    df = _TASKS["relation_tk_idx"].prepare(spark, sf, {"inputs": 64}, all_columns=True)

    def g(i, j):
        return F.coalesce(F.get(F.get("entity_token_idx", i), j), F.lit(-1)).cast("int")

    return df.select("id", _arr("input_ids").alias("input_ids"), _arr("attention_mask").alias("attention_mask"),
                     F.col("labels").cast("int").alias("labels"), g(0, 0).alias("s_first"), g(0, 1).alias("s_last"),
                     g(1, 0).alias("o_first"), g(1, 1).alias("o_last"))


# token-tag tasks
def _tag_task_sql(src_with_toks: str, tags_expr: str, pad_id: int) -> str:
    ids = "list_transform(toks, lambda t: t.id)"
    return f"""SELECT id, array_to_string({_pad(ids, 64)}, ' ') AS input_ids, array_to_string({_mask(ids, 64)}, ' ') AS attention_mask,
       array_to_string({_pad(f'({tags_expr})', 64, pad_id)}, ' ') AS labels FROM {src_with_toks}"""


def _tag_join_sql(rows: str, spans: str, iob2: list[str]) -> str:
    """Spans ``(id, k, b, e, label)`` and the tokens of ``rows`` (id, text) meet in a join; the last span (greatest ``k``) that
    touches a token wins, its first token is ``B``; ``O`` spans tag nothing."""
    iob, o = O.sql_list(iob2), iob2.index("O")
    return f"""WITH tk AS MATERIALIZED (SELECT id, toks FROM {O.with_tokens(rows)}),
     t AS (SELECT id, i, tok.id AS tid, tok.start AS ts, tok."end" AS te FROM (SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM tk)),
     s AS MATERIALIZED ({spans}),
     ov AS (SELECT t.id, t.i, s.k, s.label FROM t JOIN s ON t.id = s.id AND s.b < t.te AND s.e > t.ts WHERE s.label <> 'O'),
     f AS (SELECT id, k, min(i) AS first FROM ov GROUP BY id, k),
     l AS (SELECT id, i, max(k) AS k, arg_max(label, k) AS label FROM ov GROUP BY id, i),
     g AS (SELECT t.id, list(t.tid ORDER BY t.i) AS ids, list(CASE WHEN l.k IS NULL THEN {o}
                    ELSE list_position({iob}, (CASE WHEN f.first = t.i THEN 'B-' ELSE 'I-' END) || l.label) - 1 END ORDER BY t.i) AS tags
           FROM t LEFT JOIN l ON l.id = t.id AND l.i = t.i LEFT JOIN f ON f.id = l.id AND f.k = l.k GROUP BY t.id),
     a AS (SELECT tk.id, coalesce(ids, []) AS ids, coalesce(tags, []) AS tags FROM tk LEFT JOIN g USING (id))
SELECT id, array_to_string({_pad('ids', 64)}, ' ') AS input_ids, array_to_string({_mask('ids', 64)}, ' ') AS attention_mask,
       array_to_string({_pad('tags', 64, o)}, ' ') AS labels FROM a"""


query("task_char_ner", _tag_join_sql(f"(SELECT id, array_to_string(tokens, '') AS text FROM {O.CHARTAGS})",
                                     f'SELECT id, "begin" AS k, "begin" AS b, "end" AS e, label FROM ({QS._SPANS_SQL})', CHAR_NER_IOB2))(
    _spark_task("char_ner", TAG_LEN, "array"))


def _par_spans(label: str, types: list[str]) -> str:
    return f"""SELECT id, k, b, e, {O.sql_list(types)}[{label} + 1] AS label FROM (
       SELECT id, unnest(ne_par.begin) AS b, unnest(ne_par."end") AS e, unnest(ne_par.label) AS y, generate_subscripts(ne_par.begin, 1) AS k FROM {O.SPANS})"""


query("task_word_ner", _tag_join_sql(f"(SELECT id, text FROM {O.SPANS})", _par_spans("y", NE_TYPES), NE_IOB2))(_spark_task("word_ner", TAG_LEN, "array"))
query("task_word_ner_wide", _tag_join_sql(f"(SELECT id, text FROM {O.SPANS})", _par_spans("((e - b) * 7 + b) % 150", NE_WIDE_TYPES), NE_WIDE_IOB2))(
    _spark_task("word_ner_wide", TAG_LEN, "array"))

_EXTRACT_SRC = O.with_tokens("(SELECT *, " + QS._valid_sql() + " AS valid FROM " + QS._mention_windows_sql() + ")")
query("task_coref_span_extraction", _tag_task_sql(_EXTRACT_SRC, QS._bio_sql("flatten(valid)"), 0))(
    _spark_task("coref_span_extraction", TAG_LEN, "array"))

_PRED_INNER = f"(SELECT id, {QS._marked_sql()} AS marked, list_transform(chain, lambda c: {{'begin': {QS._shift_sql('c.begin')}, 'end': {QS._shift_sql('c.\"end\"')}}}) AS cands FROM {QS._targets_sql()})"
query("task_coref_span_prediction", _tag_task_sql(O.with_tokens(_PRED_INNER, "marked"), QS._bio_sql("cands"), 0))(
    _spark_task("coref_span_prediction", TAG_LEN, "array"))


# split variants: the base task's rows whose id falls into the validation split
_BUCKET = "(('0x' || substr(md5(chr(1) || id::VARCHAR), 1, 8))::BIGINT % 100)"
for _name, _lengths in (("word_ner", TAG_LEN), ("word_ner_wide", TAG_LEN), ("summarize", GEN_LEN), ("summarize_topic", GEN_LEN)):
    query(f"task_{_name}_split", f"SELECT * FROM ({ORACLE[f'task_{_name}']}) WHERE {_BUCKET} >= 90")(_spark_task(f"{_name}_split", _lengths, "array"))
