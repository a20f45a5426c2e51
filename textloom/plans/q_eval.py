"""Model inference (V1/U6) and whole evaluation runs over prepared tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators.evaluate import evaluate
from textloom.operators.inference import BagModel, score_batches
from textloom.plans import oracle_fixtures as O
from textloom.plans import q_metrics as QM
from textloom.plans import q_tasks as QT
from textloom.plans.fixtures import with_labels
from textloom.plans.registry import query
from textloom.plans.tasks import build_catalogue
from textloom.session import ensure_checkpoint_dir, read_table
from textloom.sources.prepared import prepare_once
from textloom.streaming.meter import read_stream
from textloom.streaming.prepare import drain_prepared, prepare_stream

_TASKS = {t.name: t for t in build_catalogue()}
_INPUTS = ["input_ids", "attention_mask", "token_type_ids"]
LENGTHS = {"inputs": 64, "targets": 16}
BATCH = 24


def _prepared(spark, sf, name: str):
    """The prepared task with its id: what an evaluation reads, made once and shared by all model steps."""
    p = _TASKS[name].prepare(spark, sf, LENGTHS, all_columns=True).select("id", "input_ids", "attention_mask", "labels")
    return prepare_once(p, f"{ensure_checkpoint_dir(spark).rstrip('/')}/prepared/{name}", split_col=None)


def _model(classes: int, step: int = 1):
    return lambda: BagModel(classes, step)


# ---------------------------------------------------------------- SQL of the model

def _model_rows(src: str, prompt: str, extra: str) -> str:
    ids = O.hash_ids(prompt)
    return f"(SELECT id, {extra}, {QT._pad('_ids', 64)} AS ids, {QT._mask('_ids', 64)} AS mask FROM (SELECT *, {ids} AS _ids FROM {src}))"


def _vote(x: str, k: str, step: int) -> str:
    return f"(({x} * {6 + step} + {k} * 3) % 11 - 5)"


def _argmax_sql(classes: int, step: int = 1) -> str:
    logits = f"list_transform(range({classes}), lambda k: list_sum(list_transform(ids, lambda x, i: mask[i] * {_vote('x', 'k', step)})))"
    return f"(list_position({logits}, list_max({logits})) - 1)"


def _generate_sql(rows: str, classes: int, n: int, step: int = 1) -> str:
    """``rows`` with ``best`` and the generated ids ``gen``."""
    chosen = f"list_filter(ids, lambda x, i: mask[i] = 1 AND {_vote('x', 'best', step)} > 0)[1:{n}]"
    return f"(SELECT *, {chosen} AS gen FROM (SELECT *, {_argmax_sql(classes, step)} AS best FROM {rows}))"


_INTENT_ROWS = _model_rows(QT._INTENT, QT._SIMPLE["intent"][1], "label")


@query("model_forward", f"SELECT id, {_argmax_sql(7)}::INT AS predictions FROM {_INTENT_ROWS}")
def model_forward(spark, sf):
    """V1 with two inputs: ids and mask go to ``forward``, whose first output is logits; a constant keyword is taken, one that
    the method does not name is dropped, as is an input that the table lacks."""
    p = _prepared(spark, sf, "intent")
    return score_batches(p, _model(7), _INPUTS, constants={"scale": 2.0, "num_beams": 4}, keep=["id"])


@query("model_logits", f"""
SELECT id, array_to_string(list_transform(range(7), lambda k: (list_sum(list_transform(ids, lambda x, i: mask[i] * {_vote('x', 'k', 1)})))::BIGINT), ' ') AS logits
FROM {_INTENT_ROWS}""")
def model_logits(spark, sf):
    """V1 for a task that keeps logits."""
    s = score_batches(_prepared(spark, sf, "intent"), _model(7), _INPUTS, logit_to_id=False, out="logits", out_type="array<double>", keep=["id"])
    return s.select("id", F.array_join(F.col("logits").cast("array<bigint>"), " ").alias("logits"))


@query("model_generate", f"SELECT id, array_to_string(gen, ' ') AS predictions FROM {_generate_sql(_INTENT_ROWS, 7, 6)}")
def model_generate(spark, sf):
    """Generate mode: the method's ids are the predictions, no argmax."""
    p = _prepared(spark, sf, "intent")
    s = score_batches(p, _model(7), _INPUTS, "generate", {"max_length": 6, "num_beams": 4}, out_type="array<int>", keep=["id"])
    return s.select("id", F.array_join("predictions", " ").alias("predictions"))


# ---------------------------------------------------------------- whole runs

def _best_sql(parts: list[str], task: str) -> str:
    """Steps' ``(metric, score, count)`` as history rows, each marked where it beats all earlier steps."""
    union = " UNION ALL ".join(f"SELECT {i + 1} AS step, * FROM ({p})" for i, p in enumerate(parts))
    return f"""SELECT '{task}' AS task, 'eval' AS tag, metric, step::BIGINT AS step, round(score, 6) AS score, count,
       score > coalesce(max(score) OVER (PARTITION BY metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE) AS is_best
FROM ({union})"""


def _history(h):
    return h.select("task", "tag", "metric", "step", F.round("score", 6).alias("score"), "count", "is_best")


_STEPS = (1, 2, 3)
_ACCEPT = QT._SIMPLE["acceptability"]


def _mcc_step_sql(step: int) -> str:
    rows = _model_rows(_ACCEPT[0], _ACCEPT[1], f"({_ACCEPT[2]}) AS t")
    return f"""
WITH i AS (SELECT t, {_argmax_sql(2, step)} AS p, (row_number() OVER (ORDER BY id) - 1) // {BATCH} AS batch FROM {rows}),
     conf AS (SELECT batch, t, p, count(*) AS n FROM i GROUP BY ALL),
     tk AS (SELECT batch, t AS k, sum(n) AS tk FROM conf GROUP BY batch, t),
     pk AS (SELECT batch, p AS k, sum(n) AS pk FROM conf GROUP BY batch, p),
     m AS (SELECT batch, sum(coalesce(tk, 0) * coalesce(pk, 0))::DOUBLE AS tp, sum(coalesce(tk, 0) * coalesce(tk, 0))::DOUBLE AS tt,
                  sum(coalesce(pk, 0) * coalesce(pk, 0))::DOUBLE AS pp FROM tk FULL JOIN pk USING (batch, k) GROUP BY batch),
     d AS (SELECT batch, sum(CASE WHEN t = p THEN n ELSE 0 END)::DOUBLE AS c, sum(n)::DOUBLE AS s FROM conf GROUP BY batch),
     b AS (SELECT CASE WHEN den = 0 THEN 0 ELSE (c * s - tp) / den END AS score, s AS count
           FROM (SELECT *, sqrt((s * s - pp) * (s * s - tt)) AS den FROM d JOIN m USING (batch)))
SELECT 'matthews_corrcoef' AS metric, sum(score * count) / sum(count) AS score, sum(count)::BIGINT AS count FROM b"""


@query("evaluate_encoder", _best_sql([_mcc_step_sql(s) for s in _STEPS], "acceptability"))
def evaluate_encoder(spark, sf):
    """Prepare, forward, join, Matthews per batch, meter, history and best step over three model steps."""
    p = _prepared(spark, sf, "acceptability")
    return _history(evaluate(_TASKS["acceptability"], p, {s: _model(2, s) for s in _STEPS}, _INPUTS, ["id"], batch_size=BATCH))


def _generated_pairs(step: int) -> str:
    rows = _model_rows(O.PAIRS, "concat_ws(' ', 'summarize:', context)", "conv_id, turn, target AS words")
    target = f"array_to_string(({O.hash_ids('words')})[1:15], ' ')"
    return (f"(SELECT id, {target} AS target, array_to_string(gen, ' ') AS prediction, (row_number() OVER (ORDER BY id) - 1) // {BATCH} AS batch "
            f"FROM {_generate_sql(rows, 7, 16, step)})")


def _gen_step_sql(step: int) -> str:
    src = _generated_pairs(step)
    return f"SELECT * FROM ({QM._bleu_sql(src=src, batch=True)}) UNION ALL SELECT * FROM ({QM._rouge_batched_sql(src)})"


@query("evaluate_generative", _best_sql([_gen_step_sql(s) for s in (1, 2)], "summarize"))
def evaluate_generative(spark, sf):
    """Prepare, generate, join, decode, BLEU and ROUGE per batch, meter, history and best step over two model steps."""
    p = _prepared(spark, sf, "summarize")
    h = evaluate(_TASKS["summarize"], p, {s: _model(7, s) for s in (1, 2)}, _INPUTS, ["id"], method="generate", constants={"max_length": 16},
                 out_type="array<int>", batch_size=BATCH)
    return _history(h)


# ---------------------------------------------------------------- streaming preparation

_TOPIC = QT._SIMPLE["topic_classify_gen"]


@query("stream_prepare", QT._task_sql(_TOPIC[0], _TOPIC[1], _TOPIC[2], "array"))
def stream_prepare(spark, sf):
    """The chain of a generative task over a stream of documents, its labels joined from a static table: equal to the batch result."""
    docs = read_stream(spark, sf, "documents", read_table(spark, sf, "documents").schema)
    source = with_labels(docs, read_table(spark, sf, "labels"))
    out = drain_prepared(prepare_stream(_TASKS["topic_classify_gen"], source, LENGTHS, all_columns=True)
                         .select("id", "input_ids", "attention_mask", "labels"), "topic_classify_gen")
    return out.select(F.col("id").cast("string").alias("id"), *[F.array_join(c, " ").alias(c) for c in ("input_ids", "attention_mask", "labels")])
