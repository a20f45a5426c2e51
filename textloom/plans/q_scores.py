"""Task-level scoring: post-processing, metrics and the count-weighted meter of a task in one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.labels import ACCEPTABILITY_CLASSES
from textloom.plans import fixtures as FX
from textloom.plans import oracle_fixtures as O
from textloom.plans.registry import query
from textloom.plans.tasks import build_catalogue
from textloom.session import read_table

_TASKS = {t.name: t for t in build_catalogue()}


def _r(df):
    return df.select("metric", F.round("score", 6).alias("score"), "count")


_RANKED = f"""(SELECT *, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS rt,
       rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp
  FROM (SELECT real_label AS t, label AS p FROM {O.SCORES}))"""


@query("score_similarity", f"""
SELECT 'pearson_corrcoef' AS metric, round(100 * corr(t, p), 6) AS score, count(*)::BIGINT AS count FROM {_RANKED}
UNION ALL SELECT 'spearman_corrcoef', round(100 * corr(rt, rp), 6), count(*)::BIGINT FROM {_RANKED}""")
def score_similarity(spark, sf):
    """Similarity regression: the rounded label predicts the real one."""
    s = FX.scores(spark, sf).select(F.col("labels.real-label").alias("real"), F.col("labels.label").alias("predictions"))
    return _r(_TASKS["similarity_reg"].score(s.select(F.col("real").alias("labels"), "predictions")))


@query("score_token_tags", f"""
SELECT 'token_accuracy' AS metric, round(100.0 * count(*) FILTER (h) / count(*), 6) AS score, count(*)::BIGINT AS count
FROM (SELECT unnest(list_transform(labels, lambda t, i: (CASE WHEN predictions[i] > 5 THEN predictions[i] ELSE 0 END) = t)) AS h,
             unnest(list_transform(labels, lambda t, i: (turn + i - 1) % 4)) AS k FROM {O.tagseq()})
WHERE k <> 0""")
def score_token_tags(spark, sf):
    """Token tagging from token logits: argmax per token, then accuracy over the unmasked tokens."""
    t = FX.tagseq(spark, sf)
    logits = F.transform("predictions", lambda p: F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.when((k == p) & (p > 5), 1.5).otherwise(0.0)))
    mask = F.transform("labels", lambda y, i: F.when((F.col("turn") + i) % 4 == 0, 0).otherwise(1))
    scored = t.select("id", "labels", logits.alias("logits"), mask.alias("attention_mask"))
    return _r(_TASKS["word_ner"].score(scored))


@query("score_acceptability_gen", """
WITH r AS (SELECT CASE WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 0 ELSE -1 END AS t, (doc_id % 3 > 0)::INT AS p FROM labels),
     conf AS (SELECT t, p, count(*) AS n FROM r GROUP BY ALL),
     k AS (SELECT DISTINCT x AS k FROM (SELECT t AS x FROM conf UNION ALL SELECT p FROM conf)),
     m AS (SELECT k, coalesce((SELECT sum(n) FROM conf WHERE t = k), 0) AS tk, coalesce((SELECT sum(n) FROM conf WHERE p = k), 0) AS pk FROM k),
     s AS (SELECT sum(tk * pk)::DOUBLE AS tp, sum(tk * tk)::DOUBLE AS tt, sum(pk * pk)::DOUBLE AS pp FROM m),
     d AS (SELECT sum(CASE WHEN t = p THEN n ELSE 0 END)::DOUBLE AS c, sum(n)::DOUBLE AS s FROM conf)
SELECT 'matthews_corrcoef' AS metric,
       round(CASE WHEN (d.s * d.s - pp) * (d.s * d.s - tt) = 0 THEN 0 ELSE (c * d.s - tp) / sqrt((d.s * d.s - pp) * (d.s * d.s - tt)) END, 6) AS score,
       d.s::BIGINT AS count FROM d, s""")
def score_acceptability_gen(spark, sf):
    """Generated class names become class ids (P6), then Matthews."""
    names = F.array(*[F.lit(n) for n in ACCEPTABILITY_CLASSES])
    lab = read_table(spark, sf, "labels")
    scored = lab.select(F.get(names, F.col("quality")).alias("labels"), F.get(names, (F.col("doc_id") % 3 > 0).cast("int")).alias("predictions"))
    return _r(_TASKS["acceptability_gen"].score(scored))


@query("score_best_step", f"""
WITH h AS (SELECT step, score FROM {O.HISTORY}),
     b AS (SELECT step, score, score > coalesce(max(score) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE) AS is_best FROM h)
SELECT step::BIGINT AS step, score, is_best FROM b""")
def score_best_step(spark, sf):
    """The best selector of a task over its score history."""
    h = FX.history(spark, sf).withColumns({"task": F.lit("topic_classify"), "metric": F.lit("accuracy")})
    return _TASKS["topic_classify"].mark_best(h).select("step", "score", "is_best")
