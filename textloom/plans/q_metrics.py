"""Queries for metrics (M*), best-so-far selection (W*), vectors (V*) and the stream meter."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from textloom.functions import post as P
from textloom.labels import CHAR_NER_IOB2, TOPIC_CLASSES
from textloom.functions import text as X
from textloom.operators import metrics as M
from textloom.operators import select as W
from textloom.operators import vectors as V
from textloom.operators.ranking import global_index
from textloom.plans import fixtures as FX
from textloom.plans import oracle_fixtures as O
from textloom.plans.registry import query
from textloom.session import read_table

_O = CHAR_NER_IOB2.index("O")
_IOB = O.sql_list(CHAR_NER_IOB2)


def _r(df):
    return df.select("metric", F.round("score", 6).alias("score"), "count")


def _metric_sql(name: str, score: str, count: str, src: str) -> str:
    return f"SELECT '{name}' AS metric, round({score}, 6) AS score, ({count})::BIGINT AS count FROM {src}"


# ---------------------------------------------------------------- M1 M2 M2b M5 M11

@query("accuracy", _metric_sql("accuracy", "100 * avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END)", "count(*)", O.CLS))
def accuracy(spark, sf):
    return _r(M.accuracy(FX.cls(spark, sf), "label", "pred"))


def _names_sql(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN coalesce({O.sql_list(TOPIC_CLASSES)}[{x} + 1], '<unk>') ELSE '<unk>' END)"


@query("exact_match", _metric_sql("exact_match_str",
                                  f"100 * avg(CASE WHEN {_names_sql('label')} = {_names_sql('pred')} THEN 1.0 ELSE 0.0 END)",
                                  "count(*)", O.CLS))
def exact_match(spark, sf):
    c = FX.cls(spark, sf).select(X.label_name("label", TOPIC_CLASSES).alias("t"),
                                 X.label_name("pred", TOPIC_CLASSES).alias("p"))
    return _r(M.exact_match(c, "t", "p"))


_ARGMAX = f"(SELECT id, labels, (list_position(logits, list_max(logits)) - 1)::INT AS pred, logits FROM {O.LOGITS})"


def _scored(spark, sf):
    lg = FX.logits(spark, sf)
    return lg.withColumn("pred", P.argmax("logits"))


@query("micro_f1_nonzero", _metric_sql(
    "f1_score_micro_sample_weight",
    "100 * sum(CASE WHEN labels <> 0 AND labels = pred THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN labels <> 0 THEN 1 ELSE 0 END), 0)",
    "sum(CASE WHEN labels <> 0 THEN 1 ELSE 0 END)", _ARGMAX))
def micro_f1_nonzero(spark, sf):
    return _r(M.micro_f1_nonzero(_scored(spark, sf), "labels", "pred"))


@query("relation_f1", f"""
SELECT 'relation_micro_f1' AS metric, round(100 * coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS score,
       pos::BIGINT AS count
FROM (SELECT sum(CASE WHEN labels = pred AND labels <> 0 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN pred <> 0 AND pred <> labels THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN labels <> 0 AND pred <> labels THEN 1 ELSE 0 END) AS fn,
             sum(CASE WHEN labels <> 0 THEN 1 ELSE 0 END) AS pos FROM {_ARGMAX})""")
def relation_f1(spark, sf):
    return _r(M.relation_f1(_scored(spark, sf), "labels", "pred"))


@query("mcc", f"""
WITH conf AS (SELECT labels AS t, pred AS p, count(*) AS n FROM {_ARGMAX} GROUP BY ALL),
     tk AS (SELECT t AS k, sum(n) AS tk FROM conf GROUP BY t),
     pk AS (SELECT p AS k, sum(n) AS pk FROM conf GROUP BY p),
     m AS (SELECT sum(coalesce(tk, 0) * coalesce(pk, 0))::DOUBLE AS tp, sum(coalesce(tk, 0) * coalesce(tk, 0))::DOUBLE AS tt,
                  sum(coalesce(pk, 0) * coalesce(pk, 0))::DOUBLE AS pp FROM tk FULL JOIN pk USING (k)),
     d AS (SELECT sum(CASE WHEN t = p THEN n ELSE 0 END)::DOUBLE AS c, sum(n)::DOUBLE AS s FROM conf)
SELECT 'matthews_corrcoef' AS metric, round(CASE WHEN den = 0 THEN 0 ELSE (c * s - tp) / den END, 6) AS score,
       s::BIGINT AS count
FROM (SELECT *, sqrt((s * s - pp) * (s * s - tt)) AS den FROM d, m)""")
def mcc(spark, sf):
    return _r(M.matthews(_scored(spark, sf), "labels", "pred"))


# ---------------------------------------------------------------- M6 M3 M4

@query("char_f1", f"""
WITH b AS (SELECT id, target AS t, prediction AS p FROM {O.PAIRS}),
     c AS (SELECT id, ch, sum(a) AS a, sum(bb) AS b FROM (
             SELECT id, unnest(string_split(t, '')) AS ch, 1 AS a, 0 AS bb FROM b
             UNION ALL SELECT id, unnest(string_split(p, '')) AS ch, 0 AS a, 1 AS bb FROM b) GROUP BY ALL),
     s AS (SELECT id, sum(least(a, b)) AS same FROM c GROUP BY id),
     r AS (SELECT b.id, length(t) AS lt, length(p) AS lp, coalesce(same, 0) AS same FROM b LEFT JOIN s USING (id))
SELECT 'f1_str' AS metric,
       round(100 * avg(CASE WHEN same = 0 THEN 0.0
                            ELSE 2 * (same / lp) * (same / lt) / ((same / lp) + (same / lt)) END), 6) AS score,
       count(*)::BIGINT AS count FROM r""")
def char_f1(spark, sf):
    return _r(M.char_f1(FX.pairs(spark, sf), "target", "prediction"))


def _bleu_tok(x: str) -> str:
    t = f"regexp_replace({x}, '(\\P{{N}})(\\p{{P}})', '\\1 \\2 ', 'g')"
    t = f"regexp_replace({t}, '(\\p{{P}})(\\P{{N}})', ' \\1 \\2', 'g')"
    t = f"regexp_replace({t}, '(\\p{{S}})', ' \\1 ', 'g')"
    return f"list_filter(regexp_split_to_array({t}, '{O.SPACE_RE}+'), lambda w: w <> '')"


def _grams(tk: str) -> str:
    return f"list_transform(range(0, len({tk}) - n + 1), lambda i: array_to_string({tk}[i + 1:i + n], ' '))"


def _gram_rows(base: str, orders: str) -> str:
    return f"""(SELECT id, n, gram, sum(a) AS a, sum(bb) AS b FROM (
    SELECT id, n, unnest({_grams('tt')}) AS gram, 1 AS a, 0 AS bb FROM {base}, range({orders}) r(n)
    UNION ALL SELECT id, n, unnest({_grams('tp')}) AS gram, 0 AS a, 1 AS bb FROM {base}, range({orders}) r(n))
  GROUP BY ALL)"""


def _bleu_sql(multi: bool = False, src: str = O.PAIRS, batch: bool = False) -> str:
    """``batch``: one score per ``batch`` of ``src`` in ``s2``, instead of one over all rows."""
    g_, by = ("batch, ", " GROUP BY batch") if batch else ("", "")
    if multi:
        base = (f"(SELECT id, [{_bleu_tok('target')}, {_bleu_tok('answer')}] AS refs, {_bleu_tok('prediction')} AS tp "
                f"FROM {O.PAIRS})")
        g = f"""(SELECT p.id, p.n, p.gram, coalesce(rm.a, 0) AS a, p.b FROM
        (SELECT id, n, gram, count(*) AS b FROM (SELECT id, n, unnest({_grams('tp')}) AS gram FROM b, range(1, 5) r(n))
         GROUP BY ALL) p
        LEFT JOIN (SELECT id, n, gram, max(a) AS a FROM (
                     SELECT id, k, n, gram, count(*) AS a FROM (
                       SELECT id, k, n, unnest({_grams('rf')}) AS gram
                       FROM (SELECT id, unnest(refs) AS rf, generate_subscripts(refs, 1) AS k FROM b), range(1, 5) r(n))
                     GROUP BY ALL) GROUP BY id, n, gram) rm USING (id, n, gram))"""
        lens = ("(SELECT sum(list_min(list_transform(refs, lambda r: {'d': abs(len(r) - len(tp)), 'len': len(r)})).len)::DOUBLE "
                "AS ref_len, sum(len(tp))::DOUBLE AS sys_len, count(*) AS rows FROM b)")
    else:
        base = f"(SELECT {g_}id, {_bleu_tok('target')} AS tt, {_bleu_tok('prediction')} AS tp FROM {src})"
        g = _gram_rows('b', '1, 5')
        lens = f"(SELECT {g_}sum(len(tt))::DOUBLE AS ref_len, sum(len(tp))::DOUBLE AS sys_len, count(*) AS rows FROM b{by})"
    cs = ", ".join(f"coalesce(max(CASE WHEN n = {k} THEN c END), 0)::DOUBLE AS c{k}, "
                   f"coalesce(max(CASE WHEN n = {k} THEN t END), 0)::DOUBLE AS t{k}" for k in range(1, 5))
    z = []
    acc = "0"
    for k in range(1, 5):
        acc = f"({acc} + CASE WHEN c{k} = 0 THEN 1 ELSE 0 END)"
        z.append(acc)
    ps = [f"(CASE WHEN t{k} = 0 THEN 0.0 WHEN c{k} = 0 THEN 100.0 / (pow(2, {z[k - 1]}) * t{k}) ELSE 100.0 * c{k} / t{k} END)"
          for k in range(1, 5)]
    logs = " + ".join(f"(CASE WHEN {p} > 0 THEN ln({p}) ELSE -9999999999.0 END)" for p in ps)
    empty = " OR ".join(f"t{k} = 0" for k in range(1, 5))
    score = (f"CASE WHEN {empty} THEN 0.0 ELSE (CASE WHEN sys_len >= ref_len THEN 1.0 WHEN sys_len > 0 THEN exp(1 - ref_len / sys_len) "
             f"ELSE 0.0 END) * exp(({logs}) / 4) END")
    if batch:
        return f"""
WITH b AS {base},
     g AS (SELECT x.*, y.batch FROM {g} x JOIN b y USING (id)),
     s AS (SELECT batch, n, sum(least(a, b)) AS c, sum(b) AS t FROM g GROUP BY batch, n),
     p AS (SELECT batch, {cs} FROM s GROUP BY batch),
     l AS {lens},
     s2 AS (SELECT coalesce({score}, 0.0) AS score, rows FROM l LEFT JOIN p USING (batch))
SELECT 'bleu' AS metric, round(sum(score * rows) / sum(rows), 6) AS score, sum(rows)::BIGINT AS count FROM s2"""
    return f"""
WITH b AS {base},
     g AS {g},
     s AS (SELECT n, sum(least(a, b)) AS c, sum(b) AS t FROM g GROUP BY n),
     p AS (SELECT {cs} FROM s),
     l AS {lens}
SELECT 'bleu' AS metric, round({score}, 6) AS score, rows::BIGINT AS count
FROM p, l"""


@query("bleu", _bleu_sql())
def bleu(spark, sf):
    return _r(M.bleu(FX.pairs(spark, sf), "target", "prediction"))


@query("bleu_multi_ref", _bleu_sql(multi=True))
def bleu_multi_ref(spark, sf):
    """M3 with two references per row: the user turn and the first word of the answer turn."""
    p = FX.pairs(spark, sf).withColumn("refs", F.array("target", "answer"))
    return _r(M.bleu_multi_ref(p, "refs", "prediction"))


def _rouge_tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query("rouge_n", f"""
WITH b AS (SELECT id, {_rouge_tok('target')} AS tt, {_rouge_tok('prediction')} AS tp FROM {O.PAIRS}),
     g AS {_gram_rows('b', '1, 3')},
     ov AS (SELECT id, n, sum(least(a, b)) AS o, sum(a) AS rt, sum(b) AS rp FROM g GROUP BY id, n),
     grid AS (SELECT id, n FROM b, range(1, 3) r(n)),
     rows_ AS (SELECT grid.id, grid.n, coalesce(o, 0) AS o, coalesce(rt, 0) AS rt, coalesce(rp, 0) AS rp
               FROM grid LEFT JOIN ov ON grid.id = ov.id AND grid.n = ov.n)
SELECT 'rouge' || n::VARCHAR AS metric,
       round(100 * avg(CASE WHEN o = 0 THEN 0.0 ELSE 2 * (o / rp) * (o / rt) / ((o / rp) + (o / rt)) END), 6) AS score,
       count(*)::BIGINT AS count
FROM rows_ GROUP BY n""")
def rouge_n(spark, sf):
    return _r(M.rouge_n(FX.pairs(spark, sf), "target", "prediction"))


def _lsum_rows_sql(src: str) -> str:
    """F-measure of rougeLsum per row: the table of longest common subsequences of each sentence pair is folded row by
    row in a recursive query; a cell holds the reference positions that its backtrack takes (a match goes diagonally,
    else up unless the left cell is longer)."""
    toks = "list_filter(regexp_split_to_array(lower(s), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"

    def sents(c):
        return f"list_filter(list_transform(string_split(replace({c}, ' . ', ' .' || chr(10)), chr(10)), lambda s: {toks}), lambda x: len(x) > 0)"

    return f"""(WITH RECURSIVE b AS (SELECT id, {sents('target')} AS rs, {sents('prediction')} AS ps FROM {src}),
     r AS (SELECT id, unnest(rs) AS r, generate_subscripts(rs, 1) AS ri FROM b),
     p AS (SELECT id, unnest(ps) AS p FROM b),
     pr AS MATERIALIZED (SELECT row_number() OVER () AS k, id, ri, r, p FROM r JOIN p USING (id)),
     dp(k, i, r, p, cells) AS (
       SELECT k, 0, r, p, list_transform(range(len(p) + 1), lambda x: []::INT[]) FROM pr
       UNION ALL
       SELECT k, i + 1, r, p, list_reduce(
         list_transform(p, lambda w, j: [[CASE WHEN w = r[i + 1] THEN 1 ELSE 0 END], cells[j], cells[j + 1]]),
         lambda acc, x: list_append(acc, CASE WHEN x[1][1] = 1 THEN list_append(x[2], i + 1)
                                              WHEN len(x[3]) >= len(acc[-1]) THEN x[3] ELSE acc[-1] END), [[]::INT[]])
       FROM dp WHERE i < len(r)),
     hit AS (SELECT DISTINCT pr.id, pr.ri, u.at AS at, pr.r[u.at] AS w
             FROM (SELECT k, unnest(cells[-1]) AS at FROM dp WHERE i = len(r)) u JOIN pr USING (k)),
     mw AS (SELECT id, w, count(*) AS m FROM hit GROUP BY id, w),
     pc AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(flatten(ps)) AS w FROM b) GROUP BY id, w),
     h AS (SELECT id, sum(least(m, c)) AS hits FROM mw JOIN pc USING (id, w) GROUP BY id)
  SELECT id, CASE WHEN coalesce(hits, 0) = 0 THEN 0.0
                  ELSE 2 * (hits / len(flatten(ps))) * (hits / len(flatten(rs))) / (hits / len(flatten(ps)) + hits / len(flatten(rs))) END AS f
  FROM b LEFT JOIN h USING (id))"""


@query("rouge_lsum", f"SELECT 'rougeLsum' AS metric, round(100 * avg(f), 6) AS score, count(*)::BIGINT AS count FROM {_lsum_rows_sql(O.PAIRS)}")
def rouge_lsum(spark, sf):
    return _r(M.rouge_lsum(FX.pairs(spark, sf), "target", "prediction"))


_REPLICATES = 1000


def _rouge_rows_sql(src: str = O.PAIRS) -> str:
    return f"""(WITH b AS (SELECT id, {_rouge_tok('target')} AS tt, {_rouge_tok('prediction')} AS tp FROM {src}),
     g AS {_gram_rows('b', '1, 3')},
     ov AS (SELECT id, n, sum(least(a, b)) AS o, sum(a) AS rt, sum(b) AS rp FROM g GROUP BY id, n)
  SELECT b.id, r.n, CASE WHEN coalesce(o, 0) = 0 THEN 0.0 ELSE 2 * (o / rp) * (o / rt) / ((o / rp) + (o / rt)) END AS f
  FROM b CROSS JOIN range(1, 3) r(n) LEFT JOIN ov ON ov.id = b.id AND ov.n = r.n)"""


def _bootstrap_sql() -> str:
    levels = M.poisson_levels()
    weight = " ".join(f"WHEN h < '{x}' THEN {k}" for k, x in enumerate(levels))
    return f"""
WITH f AS (SELECT id, 'rouge' || n AS metric, f FROM {_rouge_rows_sql()} UNION ALL SELECT id, 'rougeLsum', f FROM {_lsum_rows_sql(O.PAIRS)}),
     d AS (SELECT id, chunk, md5('0:' || chunk || ':' || id) AS d FROM (SELECT DISTINCT id FROM f) CROSS JOIN range({(_REPLICATES - 1) // 4 + 1}) c(chunk)),
     w AS (SELECT id, chunk * 4 + i AS b, CASE {weight} ELSE {len(levels)} END AS w
           FROM (SELECT id, chunk, i, substr(d, 8 * i::INT + 1, 8) AS h FROM d CROSS JOIN range(4) q(i))),
     m AS (SELECT metric, b, sum(w * f) / sum(w) AS mean FROM f JOIN w USING (id) WHERE w > 0 AND b < {_REPLICATES} GROUP BY metric, b)
SELECT metric, round(100 * quantile_cont(mean, 0.025), 6) AS low, round(100 * quantile_cont(mean, 0.5), 6) AS score,
       round(100 * quantile_cont(mean, 0.975), 6) AS high, (SELECT count(*) FROM {O.PAIRS})::BIGINT AS count
FROM m GROUP BY metric"""


@query("rouge_bootstrap", _bootstrap_sql())
def rouge_bootstrap(spark, sf):
    """M4 with the bootstrap's median and 95 % interval over 1,000 replicates."""
    r = M.rouge_bootstrap(FX.pairs(spark, sf), "target", "prediction", replicates=_REPLICATES)
    return r.select("metric", *[F.round(c, 6).alias(c) for c in ("low", "score", "high")], "count")


# ---------------------------------------------------------------- M7 M8

_LI = "(SELECT l_quantity::DOUBLE AS t, l_extendedprice::DOUBLE AS p FROM lineitem)"


@query("pearson", _metric_sql("pearson_corrcoef", "100 * corr(t, p)", "count(*)", _LI))
def pearson(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return _r(M.pearson(li, "l_quantity", "l_extendedprice"))


@query("spearman", _metric_sql("spearman_corrcoef", "100 * corr(rt, rp)", "count(*)", f"""(
  SELECT rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS rt,
         rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM {_LI})"""))
def spearman(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return _r(M.spearman(li, "l_quantity", "l_extendedprice"))


_LI_FLAG = "(SELECT l_returnflag, l_quantity::DOUBLE AS t, l_extendedprice::DOUBLE AS p FROM lineitem)"


@query("pearson_by_flag", f"""
SELECT l_returnflag, 'pearson_corrcoef' AS metric, round(100 * corr(t, p), 6) AS score, count(*)::BIGINT AS count
FROM {_LI_FLAG} GROUP BY l_returnflag""")
def pearson_by_flag(spark, sf):
    li = read_table(spark, sf, "lineitem")
    r = M.pearson(li, "l_quantity", "l_extendedprice", group=["l_returnflag"])
    return r.select("l_returnflag", "metric", F.round("score", 6).alias("score"), "count")


@query("spearman_by_flag", f"""
SELECT l_returnflag, 'spearman_corrcoef' AS metric, round(100 * corr(rt, rp), 6) AS score, count(*)::BIGINT AS count
FROM (SELECT l_returnflag,
             rank() OVER (PARTITION BY l_returnflag ORDER BY t) + (count(*) OVER (PARTITION BY l_returnflag, t) - 1) / 2.0 AS rt,
             rank() OVER (PARTITION BY l_returnflag ORDER BY p) + (count(*) OVER (PARTITION BY l_returnflag, p) - 1) / 2.0 AS rp
      FROM {_LI_FLAG})
GROUP BY l_returnflag""")
def spearman_by_flag(spark, sf):
    li = read_table(spark, sf, "lineitem")
    r = M.spearman(li, "l_quantity", "l_extendedprice", group=["l_returnflag"])
    return r.select("l_returnflag", "metric", F.round("score", 6).alias("score"), "count")


@query("token_ce_loss", _metric_sql(
    "ce_loss", "avg(ln(12 + exp(2.0)) - CASE WHEN y = p THEN 2.0 ELSE 0.0 END)", "count(*)",
    f"""(SELECT unnest(labels) AS y, unnest(predictions) AS p, unnest(list_transform(labels, lambda y, i: (turn + i - 1) % 3)) AS k
         FROM {O.tagseq()}) WHERE k <> 0"""))
def token_ce_loss(spark, sf):
    t = FX.tagseq(spark, sf)
    # per-token logits: 2.0 on the predicted tag, 0 elsewhere (13 tags); the mask skips every third word
    t = t.withColumns({
        "logits": F.transform("predictions", lambda p: F.transform(F.sequence(F.lit(0), F.lit(12)),
                                                                   lambda k: F.when(k == p, 2.0).otherwise(0.0))),
        "mask": F.transform("labels", lambda y, i: F.when((F.col("turn") + i) % 3 == 0, 0).otherwise(1)),
    })
    return _r(M.token_ce_loss(t, "logits", "labels", "mask"))


@query("pearson_scores",_metric_sql("pearson_corrcoef", "100 * corr(real_label, label)", "count(*)", O.SCORES))
def pearson_scores(spark, sf):
    s = FX.scores(spark, sf).select(F.col("labels.real-label").alias("t"), F.col("labels.label").alias("p"))
    return _r(M.pearson(s, "t", "p"))


# ---------------------------------------------------------------- M9 M10 M12 M13

_TAGSEQ = O.tagseq()


@query("token_accuracy", _metric_sql(
    "token_accuracy", "100 * sum(h) / sum(n)", "sum(n)",
    f"(SELECT len(list_filter(list_transform(labels, lambda t, i: t = predictions[i]), lambda x: x)) AS h, len(labels) AS n FROM {_TAGSEQ})"))
def token_accuracy(spark, sf):
    return _r(M.token_accuracy(FX.tagseq(spark, sf), "labels", "predictions"))


_RAGGED = "predictions[1:len(predictions) - 1]"


@query("token_accuracy_ragged", _metric_sql(
    "token_accuracy", "100 * sum(h) / sum(n)", "sum(n)",
    f"""(SELECT len(list_filter(list_transform(labels[1:least(len(labels), len({_RAGGED}))], lambda t, i: t = ({_RAGGED})[i]), lambda x: x)) AS h,
               least(len(labels), len({_RAGGED})) AS n FROM {_TAGSEQ})"""))
def token_accuracy_ragged(spark, sf):
    return _r(M.token_accuracy_ragged(FX.tagseq(spark, sf), "labels", "ragged"))


def _char_views_sql() -> str:
    c2t = ("list_transform(range(length(text)), lambda p: "
           "(list_position(list_transform(wo, lambda s: s.off <= p AND p < s.off + length(s.w)), true) - 1)::INT)")
    cover = 'list_filter("NE", lambda s: s.begin <= p AND p < s."end")'
    ct = (f"list_transform(range(length(text)), lambda p: CASE WHEN len({cover}) = 0 THEN {_O} ELSE "
          f"list_position({_IOB}, (CASE WHEN {cover}[1].begin = p THEN 'B-' ELSE 'I-' END) || {cover}[1].label) - 1 END)")
    pred = (f"list_transform(range(length(text)), lambda p: CASE "
            f"WHEN c2t[p + 1] IS NULL OR predictions[c2t[p + 1] + 1] IS NULL OR {_IOB}[predictions[c2t[p + 1] + 1] + 1] = 'O' THEN {_O} "
            f"WHEN starts_with({_IOB}[predictions[c2t[p + 1] + 1] + 1], 'B') AND p > 0 AND c2t[p] = c2t[p + 1] "
            f"THEN list_position({_IOB}, 'I' || substr({_IOB}[predictions[c2t[p + 1] + 1] + 1], 2)) - 1 "
            f"ELSE predictions[c2t[p + 1] + 1] END)")
    return f"(SELECT id, ct, {pred} AS cp FROM (SELECT *, {c2t} AS c2t, {ct} AS ct FROM {_TAGSEQ}))"


def _char_views(spark, sf):
    t = FX.tagseq(spark, sf)
    return t.withColumn("cp", M.token_tags_to_char_tags("predictions", "c2t", CHAR_NER_IOB2))


@query("token_tags_to_char_tags", f"""
SELECT id, md5(array_to_string(cp, ' ')) AS pred_md5, md5(array_to_string(ct, ' ')) AS true_md5 FROM {_char_views_sql()}""")
def token_tags_to_char_tags(spark, sf):
    v = _char_views(spark, sf)
    return v.select("id", F.md5(F.array_join("cp", " ")).alias("pred_md5"),
                    F.md5(F.array_join("char_tags", " ")).alias("true_md5"))


def _char_f1_sql(compat: bool) -> str:
    final = ("round(sum(100 * macro) / sum(ent), 6) AS score, sum(ent)::BIGINT AS count" if compat
             else "round(100 * avg(macro), 6) AS score, count(*)::BIGINT AS count")
    return f"""
WITH ch AS (SELECT id, unnest(ct) AS t, unnest(cp) AS p FROM {_char_views_sql()}),
     lab AS (SELECT id, t AS lab, CASE WHEN t <> {_O} AND t = p THEN 1 ELSE 0 END AS tp, 0 AS fp,
                    CASE WHEN t <> {_O} AND t <> p THEN 1 ELSE 0 END AS fn, CASE WHEN t <> {_O} THEN 1 ELSE 0 END AS ent FROM ch
             UNION ALL
             SELECT id, p AS lab, 0 AS tp, CASE WHEN t <> {_O} AND t <> p THEN 1 ELSE 0 END AS fp, 0 AS fn, 0 AS ent FROM ch),
     pl AS (SELECT id, lab, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(ent) AS ent FROM lab GROUP BY ALL),
     ps AS (SELECT id, avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END) AS macro,
                   sum(ent) AS ent FROM pl GROUP BY id HAVING sum(ent) > 0)
SELECT 'char_f1' AS metric, {final} FROM ps"""


@query("char_entity_f1", _char_f1_sql(False))
def char_entity_f1(spark, sf):
    return _r(M.char_entity_f1(_char_views(spark, sf), "char_tags", "cp", CHAR_NER_IOB2))


@query("char_entity_f1_compat", _char_f1_sql(True))
def char_entity_f1_compat(spark, sf):
    return _r(M.char_entity_f1(_char_views(spark, sf), "char_tags", "cp", CHAR_NER_IOB2, compat=True))


# ---------------------------------------------------------------- M14-M18

def _lse(a: str) -> str:
    return f"(list_max({a}) + ln(list_sum(list_transform({a}, lambda x: exp(x - list_max({a}))))))"


@query("ce_loss", _metric_sql("ce_loss", "avg(" + _lse("logits") + " - logits[labels + 1])", "count(*)", O.LOGITS))
def ce_loss(spark, sf):
    return _r(M.ce_loss(FX.logits(spark, sf), "logits", "labels"))


@query("mse_loss", _metric_sql("mse_loss", "avg((l_discount - l_tax) * (l_discount - l_tax))", "count(*)", "lineitem"))
def mse_loss(spark, sf):
    return _r(M.mse_loss(read_table(spark, sf, "lineitem"), "l_discount", "l_tax"))


@query("bce_loss", _metric_sql(
    "bce_loss", "avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x))))", "count(*)",
    f"(SELECT unnest(logits) AS x, unnest(list_transform(range(len(logits)), lambda i: CASE WHEN i = labels THEN 1.0 ELSE 0.0 END)) AS y FROM {O.LOGITS})"))
def bce_loss(spark, sf):
    lg = FX.logits(spark, sf)
    lg = lg.withColumn("targets", F.transform(F.sequence(F.lit(0), F.size("logits") - 1),
                                              lambda i: F.when(i == F.col("labels"), 1.0).otherwise(0.0)))
    return _r(M.bce_loss(lg, "logits", "targets"))


@query("meter_average", f"""
WITH i AS (SELECT label, pred, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch FROM {O.CLS}),
     b AS (SELECT batch, 100 * avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS score, count(*) AS count FROM i GROUP BY batch)
SELECT 'accuracy' AS metric, round(sum(score * count) / sum(count), 6) AS score, sum(count)::BIGINT AS count FROM b""")
def meter_average(spark, sf):
    c = global_index(FX.cls(spark, sf).select("id", "label", "pred"), ["id"], "idx")
    c = c.withColumn("batch", F.floor(F.col("idx") / 32))
    per_batch = M.batched(c, "batch", None, target="label", prediction="pred")
    return _r(M.meter_average(per_batch))


@query("meter_batched_mcc", f"""
WITH i AS (SELECT labels AS t, pred AS p, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch FROM {_ARGMAX}),
     conf AS (SELECT batch, t, p, count(*) AS n FROM i GROUP BY ALL),
     tk AS (SELECT batch, t AS k, sum(n) AS tk FROM conf GROUP BY batch, t),
     pk AS (SELECT batch, p AS k, sum(n) AS pk FROM conf GROUP BY batch, p),
     m AS (SELECT batch, sum(coalesce(tk, 0) * coalesce(pk, 0))::DOUBLE AS tp, sum(coalesce(tk, 0) * coalesce(tk, 0))::DOUBLE AS tt,
                  sum(coalesce(pk, 0) * coalesce(pk, 0))::DOUBLE AS pp FROM tk FULL JOIN pk USING (batch, k) GROUP BY batch),
     d AS (SELECT batch, sum(CASE WHEN t = p THEN n ELSE 0 END)::DOUBLE AS c, sum(n)::DOUBLE AS s FROM conf GROUP BY batch),
     b AS (SELECT CASE WHEN den = 0 THEN 0 ELSE (c * s - tp) / den END AS score, s AS count
           FROM (SELECT *, sqrt((s * s - pp) * (s * s - tt)) AS den FROM d JOIN m USING (batch)))
SELECT 'matthews_corrcoef' AS metric, round(sum(score * count) / sum(count), 6) AS score, sum(count)::BIGINT AS count FROM b""")
def meter_batched_mcc(spark, sf):
    """M17 with a non-decomposable metric: per-batch Matthews weighted by batch size, as the reference's meter."""
    s = global_index(_scored(spark, sf).select("id", "labels", "pred"), ["id"], "idx")
    s = s.withColumn("batch", F.floor(F.col("idx") / 32))
    per_batch = M.batched(s, "batch", M.matthews, target="labels", prediction="pred")
    return _r(M.meter_average(per_batch))


def _batches(df, order: list[str]):
    return global_index(df, order, "idx").withColumn("batch", F.floor(F.col("idx") / 32))


_PAIR_BATCH = f"(SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 32 AS batch FROM {O.PAIRS})"


def _pair_batches(spark, sf):
    return _batches(FX.pairs(spark, sf).select("id", "conv_id", "turn", "target", "prediction"), ["conv_id", "turn"])


@query("meter_batched_f1", f"""
WITH i AS (SELECT labels AS t, pred AS p, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch FROM {_ARGMAX}),
     b AS (SELECT batch, 100.0 * sum(CASE WHEN t <> 0 AND t = p THEN 1 ELSE 0 END) / sum(CASE WHEN t <> 0 THEN 1 ELSE 0 END) AS score,
                  sum(CASE WHEN t <> 0 THEN 1 ELSE 0 END) AS count FROM i GROUP BY batch HAVING sum(CASE WHEN t <> 0 THEN 1 ELSE 0 END) > 0)
SELECT 'f1_score_micro_sample_weight' AS metric, round(sum(score * count) / sum(count), 6) AS score, sum(count)::BIGINT AS count FROM b""")
def meter_batched_f1(spark, sf):
    """M17 over M2: batches without a positive target have no weight."""
    s = _batches(_scored(spark, sf).select("id", "labels", "pred"), ["id"])
    return _r(M.meter_average(M.batched(s, "batch", M.micro_f1_nonzero, target="labels", prediction="pred")))


@query("meter_batched_bleu", _bleu_sql(src=_PAIR_BATCH, batch=True))
def meter_batched_bleu(spark, sf):
    """M17 over M3: corpus BLEU of each batch, weighted by its rows."""
    return _r(M.meter_average(M.batched(_pair_batches(spark, sf), "batch", M.bleu, target="target", prediction="prediction")))


def _rouge_batched_sql(src: str) -> str:
    """``src``: id, target, prediction, batch."""
    return f"""
WITH i AS (SELECT id, batch FROM {src}),
     f AS (SELECT id, 'rouge' || n AS metric, f FROM {_rouge_rows_sql(src)} UNION ALL SELECT id, 'rougeLsum', f FROM {_lsum_rows_sql(src)}),
     b AS (SELECT metric, batch, 100 * avg(f) AS score, count(*) AS count FROM f JOIN i USING (id) GROUP BY metric, batch)
SELECT metric, round(sum(score * count) / sum(count), 6) AS score, sum(count)::BIGINT AS count FROM b GROUP BY metric"""


@query("meter_batched_rouge", _rouge_batched_sql(_PAIR_BATCH))
def meter_batched_rouge(spark, sf):
    """M17 over M4, all keys."""
    b = _pair_batches(spark, sf)
    scores = M.batched(b, "batch", M.rouge_n, target="target", prediction="prediction")
    return _r(M.meter_average(scores.unionByName(M.batched(b, "batch", M.rouge_lsum, target="target", prediction="prediction"))))


def _char_f1_batched_sql() -> str:
    body = _char_f1_sql(False)
    ps = body[:body.rindex("SELECT 'char_f1'")].rstrip()
    return f"""{ps},
     i AS (SELECT id, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 32 AS batch FROM {_TAGSEQ}),
     b AS (SELECT batch, 100 * avg(macro) AS score, count(*) AS count FROM ps JOIN i USING (id) GROUP BY batch)
SELECT 'char_f1' AS metric, round(sum(score * count) / sum(count), 6) AS score, sum(count)::BIGINT AS count FROM b"""


@query("meter_batched_entities", _char_f1_batched_sql())
def meter_batched_entities(spark, sf):
    """M17 over M13: a batch without any entity has no row."""
    v = _batches(_char_views(spark, sf).select("id", "conv_id", "turn", "char_tags", "cp"), ["conv_id", "turn"])
    return _r(M.meter_average(M.batched(v, "batch", M.char_entity_f1, char_tags="char_tags", pred_char_tags="cp", tag_list=CHAR_NER_IOB2)))


# ---------------------------------------------------------------- M20 W1-W4

def _hist(spark, sf):
    return FX.history(spark, sf).withColumns({"task": F.lit("topic_classify"), "metric": F.lit("pct_low")})


@query("metric_history", f"""
SELECT 'topic_classify' AS task, 'validation' AS tag, 'pct_low' AS metric, step::BIGINT AS step, score, count,
       printf('%s/%s: %.3f', 'validation', 'pct_low', score) AS line FROM {O.HISTORY}""")
def metric_history(spark, sf):
    h = FX.history(spark, sf).withColumn("metric", F.lit("pct_low"))
    return M.metric_history(h, "topic_classify", "validation")


def _best_sql(agg: str, cmp: str, start: str) -> str:
    return f"""
SELECT 'topic_classify' AS task, 'pct_low' AS metric, step, score,
       score {cmp} coalesce({agg}(score) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '{start}'::DOUBLE) AS is_best
FROM {O.HISTORY}"""


@query("best_so_far_max", _best_sql("max", ">", "-inf"))
def best_so_far_max(spark, sf):
    return W.greater_is_best(_hist(spark, sf)).select("task", "metric", "step", "score", "is_best")


@query("best_so_far_min", _best_sql("min", "<", "inf"))
def best_so_far_min(spark, sf):
    return W.less_is_best(_hist(spark, sf)).select("task", "metric", "step", "score", "is_best")


@query("best_always", f"SELECT 'topic_classify' AS task, 'pct_low' AS metric, step, score, true AS is_best FROM {O.HISTORY}")
def best_always(spark, sf):
    return W.always_best(_hist(spark, sf)).select("task", "metric", "step", "score", "is_best")


@query("best_step", f"""
SELECT 'topic_classify' AS task, 'pct_low' AS metric,
       (SELECT min(step) FROM {O.HISTORY} WHERE score = (SELECT max(score) FROM {O.HISTORY})) AS best_step,
       (SELECT max(score) FROM {O.HISTORY}) AS best_score""")
def best_step(spark, sf):
    return W.best_step(_hist(spark, sf))


# ---------------------------------------------------------------- V1-V5

def _dims_sql(src: str, cond: str = "true") -> str:
    return f"(SELECT seq, pos, mask, unnest(vec)::DOUBLE AS v, (generate_subscripts(vec, 1) - 1)::INT AS dim FROM {src} WHERE {cond})"


_MASKED = f"SELECT seq, dim, sum(mask * v) / sqrt(sum(mask)) AS value FROM {_dims_sql(O.VECTORS)} GROUP BY seq, dim"
_SPAN = f"SELECT seq, dim, avg(v) AS value FROM {_dims_sql(O.VECTORS, 'pos BETWEEN 1 AND 4')} GROUP BY seq, dim"
_START = f"SELECT seq, dim, v AS value FROM {_dims_sql(O.VECTORS, 'pos = 0')}"


def _rv(df):
    return df.select("seq", "dim", F.round("value", 6).alias("value"))


def _rv_sql(q: str) -> str:
    return f"SELECT seq, dim, round(value, 6) AS value FROM ({q})"


@query("masked_pool", _rv_sql(_MASKED))
def masked_pool(spark, sf):
    return _rv(V.masked_pool(FX.vectors(spark, sf)))


@query("span_pool", _rv_sql(_SPAN))
def span_pool(spark, sf):
    return _rv(V.span_pool(FX.vectors(spark, sf), 1, 4))


@query("start_pool", _rv_sql(_START))
def start_pool(spark, sf):
    return _rv(V.start_pool(FX.vectors(spark, sf)))


@query("concat_pool", _rv_sql(f"""
SELECT seq, dim, value FROM ({_START}) UNION ALL SELECT seq, dim + 64, value FROM ({_SPAN})
UNION ALL SELECT seq, dim + 128, value FROM ({_MASKED})"""))
def concat_pool(spark, sf):
    return _rv(V.fused_pools(FX.vectors(spark, sf), span=(1, 4), at=0))


def _weights(dim: int = 64, out: int = 10) -> np.ndarray:
    i = np.arange(dim)[:, None]
    j = np.arange(out)[None, :]
    return ((i * 7 + j * 3) % 11 - 5) / 10.0


@query("batch_score", """
SELECT id, (list_position(s, list_max(s)) - 1)::INT AS pred FROM (
  SELECT vec_id AS id, list_transform(range(10), lambda j: list_sum(list_transform(embedding, lambda x, i:
           x::DOUBLE * ((((i - 1) * 7 + j * 3) % 11) - 5) / 10.0))) AS s FROM embeddings)""")
def batch_score(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    scored = V.batch_score(e, V.linear_model(_weights()), "embedding", keep=["id"])
    return scored.select("id", P.argmax("predictions").alias("pred"))


# ---------------------------------------------------------------- stream

@query("stream_meter", """
SELECT 'long_turn' AS metric, role AS key, round(100.0 * sum(CASE WHEN length(text) > 200 THEN 1 ELSE 0 END) / count(*), 6) AS score,
       count(*)::BIGINT AS count FROM conversations GROUP BY role""")
def stream_meter(spark, sf):
    from textloom.streaming.meter import read_stream, run_to_table, running_meter

    schema = read_table(spark, sf, "conversations").schema
    s = read_stream(spark, sf, "conversations", schema)
    meter = running_meter(s, "role", F.length("text") > 200, "long_turn")
    out = run_to_table(spark, meter, f"stream_meter_{uuid.uuid4().hex[:8]}")
    return out.select("metric", "key", F.round("score", 6).alias("score"), "count")
