"""Metrics (M1-M20) as distributed aggregations.

Every metric returns a DataFrame ``(metric STRING, score DOUBLE, count BIGINT)``
computed exactly over all rows (not averaged per batch).  Sums are merged by
Spark's partial/final aggregation, so a metric over 100 TB is one pass plus a
one-row final step.  With ``group`` a metric gives one row per group, which
``batched`` uses to reproduce the per-batch meter.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.hof import bind_column, let, let_many, shift_right
from textloom.functions.text import SPACE_CLASS
from textloom.operators.ranking import average_rank


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _result(df: DataFrame, name: str, score: Column, count: Column, group: list[str] = ()) -> DataFrame:
    """``(*group, metric, score, count)``: one row, or one per group."""
    return df.groupBy(*group).agg(score.cast("double").alias("score"), count.cast("bigint").alias("count")) \
        .select(*group, F.lit(name).alias("metric"), "score", "count")


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


# ---------------------------------------------------------------- M1 M2 M2b M5 M11

def accuracy(df: DataFrame, target="labels", prediction="predictions", name: str = "accuracy", group: list[str] = ()) -> DataFrame:
    """M1/M5: 100 · mean(target = prediction)."""
    hit = _c(target).eqNullSafe(_c(prediction)).cast("double")
    return _result(df, name, F.avg(hit) * 100, F.count(F.lit(1)), group)


def exact_match(df: DataFrame, target="labels", prediction="predictions", group: list[str] = ()) -> DataFrame:
    """M5: string exact match."""
    return accuracy(df, target, prediction, "exact_match_str", group)


def micro_f1_nonzero(df: DataFrame, target="labels", prediction="predictions", group: list[str] = ()) -> DataFrame:
    """M2: micro-F1 with weight 0 on target 0 = accuracy over rows whose target ≠ 0 (NULL and count 0 if none)."""
    t, p = _c(target), _c(prediction)
    w = (t != 0).cast("long")
    score = _ratio(F.sum(w * (t == p).cast("long")), F.sum(w)) * 100
    return _result(df, "f1_score_micro_sample_weight", score, F.sum(w), group)


def relation_f1(df: DataFrame, target="labels", prediction="predictions", negative: int = 0, group: list[str] = ()) -> DataFrame:
    """Micro-F1 over the positive classes (class ``negative`` excluded)."""
    t, p = _c(target), _c(prediction)
    tp = F.sum(((t == p) & (t != negative)).cast("long"))
    fp = F.sum(((p != negative) & (p != t)).cast("long"))
    fn = F.sum(((t != negative) & (p != t)).cast("long"))
    score = F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)) * 100
    return _result(df, "relation_micro_f1", score, F.sum((t != negative).cast("long")), group)


def matthews(df: DataFrame, target="labels", prediction="predictions", group: list[str] = ()) -> DataFrame:
    """Multiclass Matthews correlation (not ×100); 0 when the denominator is 0.

    Aggregations over the confusion counts only (classes² rows per group), so
    the data is read once; ``group`` gives one score per group (e.g. per batch).
    """
    g = list(group)
    conf = df.groupBy(*g, _c(target).alias("t"), _c(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tk = conf.groupBy(*g, F.col("t").alias("k")).agg(F.sum("n").alias("tk"))
    pk = conf.groupBy(*g, F.col("p").alias("k")).agg(F.sum("n").alias("pk"))
    marg = tk.join(pk, [*g, "k"], "full").select(*g, F.coalesce("tk", F.lit(0)).cast("double").alias("tk"),
                                                 F.coalesce("pk", F.lit(0)).cast("double").alias("pk"))
    m = marg.groupBy(*g).agg(F.sum(F.col("tk") * F.col("pk")).alias("tp"), F.sum(F.col("tk") * F.col("tk")).alias("tt"),
                             F.sum(F.col("pk") * F.col("pk")).alias("pp"))
    d = conf.groupBy(*g).agg(F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).cast("double").alias("c"),
                             F.sum("n").cast("double").alias("s"))
    # both sides have one row per group: stack them and fold
    j = d.unionByName(m, allowMissingColumns=True).groupBy(*g).agg(
        *[F.max(c).alias(c) for c in ("c", "s", "tp", "tt", "pp")])
    num = F.col("c") * F.col("s") - F.col("tp")
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    score = F.when(den == 0, F.lit(0.0)).otherwise(_ratio(num, den))
    return j.select(*g, F.lit("matthews_corrcoef").alias("metric"), score.alias("score"),
                    F.col("s").cast("bigint").alias("count"))


# ---------------------------------------------------------------- M7 M8

def pearson(df: DataFrame, target="labels", prediction="predictions", name: str = "pearson_corrcoef",
            group: list[str] = ()) -> DataFrame:
    """M7: 100 · Pearson r (per ``group`` when given); NULL when a side is constant.

    Uses Spark's co-moment aggregates (numerically stable merge of partial
    states), not raw power sums.
    """
    t, p = _c(target).cast("double"), _c(prediction).cast("double")
    den = F.stddev_pop(t) * F.stddev_pop(p)
    return _result(df, name, F.when(den > 0, F.covar_pop(t, p) / den) * 100, F.count(F.lit(1)), group)


def spearman(df: DataFrame, target="labels", prediction="predictions", partitions: int | None = None,
             group: list[str] = ()) -> DataFrame:
    """M8: 100 · Spearman rho with average ranks for ties (per ``group`` when given).

    Each side is ranked on its distinct values with a range-partitioned
    running sum (``average_rank``), joined back on (group, value), then M7.
    """
    g = list(group)
    base = df.select(*g, _c(target).cast("double").alias("_t"), _c(prediction).cast("double").alias("_p"))
    # equal pairs are counted first, so a tied value costs one row per partner, not one per input row
    pairs = base.groupBy(*g, "_t", "_p").agg(F.count(F.lit(1)).alias("_n"))
    rt = average_rank(base, "_t", "_rt", partitions, g).select(*g, "_t", "_rt")
    rp = average_rank(base, "_p", "_rp", partitions, g).select(*g, "_p", "_rp")
    ranked = pairs.join(rt, [*g, "_t"]).join(rp, [*g, "_p"])
    n, t, p = F.col("_n").cast("double"), F.col("_rt"), F.col("_rp")
    sums = ranked.groupBy(*g).agg(F.sum(n).alias("n"), F.sum(n * t).alias("t"), F.sum(n * p).alias("p"),
                                  F.sum(n * t * t).alias("tt"), F.sum(n * p * p).alias("pp"), F.sum(n * t * p).alias("tp"))
    # ranks are multiples of one half: the sums are exact up to 2**53
    den = F.sqrt(F.col("tt") - F.col("t") * F.col("t") / F.col("n")) * F.sqrt(F.col("pp") - F.col("p") * F.col("p") / F.col("n"))
    score = F.when(den > 0, (F.col("tp") - F.col("t") * F.col("p") / F.col("n")) / den) * 100
    return sums.select(*g, F.lit("spearman_corrcoef").alias("metric"), score.alias("score"),
                       F.coalesce("n", F.lit(0.0)).cast("bigint").alias("count"))


# ---------------------------------------------------------------- M9 M10

def _sum_array(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint"))


def token_accuracy(df: DataFrame, target="labels", prediction="predictions", mask: str | None = None, group: list[str] = ()) -> DataFrame:
    """M9: flattened token accuracy over equal-length arrays; optional mask weights."""
    t, p = _c(target), _c(prediction)
    hits = F.zip_with(t, p, lambda a, b: F.when(a == b, 1).otherwise(0))
    if mask:
        w = _c(mask)
        num = _sum_array(F.zip_with(hits, w, lambda h, m: h * m))
        den = _sum_array(w)
    else:
        num = _sum_array(hits)
        den = F.size(t).cast("bigint")
    return _result(df, "token_accuracy", _ratio(F.sum(num), F.sum(den)) * 100, F.sum(den), group)


def token_accuracy_ragged(df: DataFrame, target="labels", prediction="predictions", mask: str | None = None,
                          compat: bool = False, group: list[str] = ()) -> DataFrame:
    """Pairs up to the shorter array.  With ``mask`` (default behaviour for
    padded targets) positions with mask 0 are skipped; ``compat`` counts them, as upstream."""
    t, p = _c(target), _c(prediction)
    m = F.least(F.size(t), F.size(p))
    ts, ps = F.slice(t, 1, m), F.slice(p, 1, m)
    hits = F.zip_with(ts, ps, lambda a, b: F.when(a == b, 1).otherwise(0))
    if mask and not compat:
        w = F.slice(_c(mask), 1, m)
        num = _sum_array(F.zip_with(hits, w, lambda h, k: h * k))
        den = _sum_array(w)
    else:
        num = _sum_array(hits)
        den = m.cast("bigint")
    return _result(df, "token_accuracy", _ratio(F.sum(num), F.sum(den)) * 100, F.sum(den), group)


# ---------------------------------------------------------------- M6

def char_f1(df: DataFrame, target="labels", prediction="predictions", id_col: str = "id", group: list[str] = ()) -> DataFrame:
    """M6: per-row multiset character-overlap F1 (0 when nothing in common), mean × 100.

    Both sides' characters (plus one marker so rows without characters still
    count) are exploded in one pass and counted per (row, char) — a shuffle
    on (row, char) with map-side partial sums — then per row: overlap and
    both lengths come out of the same aggregation, so no join is needed.
    """
    def side(col, a, b):
        # a NULL text has no characters; its row still counts
        return F.transform(F.split(F.coalesce(_c(col), F.lit("")), "", -1), lambda ch: F.struct(ch.alias("ch"), F.lit(a).alias("a"), F.lit(b).alias("b")))

    marker = F.array(F.struct(F.lit(None).cast("string").alias("ch"), F.lit(0).alias("a"), F.lit(0).alias("b")))
    items = F.concat(side(target, 1, 0), side(prediction, 0, 1), marker)
    e = df.select(*group, _c(id_col).alias("_id"), F.explode(items).alias("x")) \
        .select(*group, "_id", "x.ch", "x.a", "x.b").where(F.col("ch").isNull() | (F.col("ch") != ""))
    per_char = e.groupBy(*group, "_id", "ch").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = per_char.groupBy(*group, "_id").agg(F.sum(F.least("a", "b")).alias("same"), F.sum("a").alias("lt"),
                                       F.sum("b").alias("lp"))
    prec = _ratio(F.col("same"), F.col("lp"))
    rec = _ratio(F.col("same"), F.col("lt"))
    f1 = F.when(F.col("same") == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
    return _result(rows, "f1_str", F.avg(f1) * 100, F.count(F.lit(1)), group)


# ---------------------------------------------------------------- M3 M4

def bleu_tokens(text) -> Column:
    """International BLEU tokenization: split punctuation unless next to a digit, split symbols."""
    t = _c(text)
    t = F.regexp_replace(t, r"(\P{N})(\p{P})", "$1 $2 ")
    t = F.regexp_replace(t, r"(\p{P})(\P{N})", " $1 $2")
    t = F.regexp_replace(t, r"(\p{S})", " $1 ")
    return F.filter(F.split(t, f"[{SPACE_CLASS}]+", -1), lambda w: w != F.lit(""))


def ngrams(tokens, n: int, prefix: str = "") -> Column:
    """All n-grams of a token array as space-joined strings, optionally prefixed (token array bound once)."""
    if n <= 1:
        return F.transform(_c(tokens), lambda w: F.concat(F.lit(prefix), w)) if prefix else _c(tokens)
    return let(_c(tokens), lambda tk: F.transform(F.sequence(F.lit(0), F.size(tk) - n), lambda i: F.concat(
        F.lit(prefix), F.array_join(F.slice(tk, i + 1, n), " ")) if prefix else F.array_join(F.slice(tk, i + 1, n), " ")))


def _gram_counts(df: DataFrame, target, prediction, id_col: str, tokens, orders: list[int], group: list[str] = ()) -> DataFrame:
    """``(*group, _id, n, c, a, b, na, nb)``: per id and order the grams of the target (a), of the prediction (b) and in common (c).

    Only texts are shuffled, so that rows of one id meet and count together; their grams never leave the row.  Per order
    the grams of both sides are sorted in one array and folded: each gram of the prediction takes one of the target's
    that is left.  Every (id, order) has a row; a text without grams counts as one NULL gram (``na`` and ``nb`` of them).
    """
    texts = df.select(*group, _c(id_col).alias("_id"), F.struct(_c(target).alias("t"), _c(prediction).alias("p")).alias("_x"))
    texts = texts.groupBy(*group, "_id").agg(F.collect_list("_x").alias("_x"))
    texts = bind_column(texts, "_y", F.transform("_x", lambda x: F.struct(tokens(x["t"]).alias("t"), tokens(x["p"]).alias("p"))))
    empty = F.array(F.lit(None).cast("string"))

    def grams(side: str, n: int):
        return F.flatten(F.transform("_y", lambda x: F.when(F.size(x[side]) >= n, ngrams(x[side], n)).otherwise(empty)))

    def fold(acc, x):
        left = F.when(acc["g"].eqNullSafe(x["g"]), acc["left"]).otherwise(F.lit(0))
        hit = ((x["s"] == 1) & (left > 0)).cast("int")
        return F.struct(x["g"].alias("g"), (left + F.when(x["s"] == 0, F.lit(1)).otherwise(-hit)).alias("left"), (acc["c"] + hit).alias("c"))

    def marked(side: str, n: int, s: int):
        return F.transform(grams(side, n), lambda g: F.struct(g.alias("g"), F.lit(s).alias("s")))

    def counted(n: int):
        both = F.concat(marked("t", n, 0), marked("p", n, 1))
        none = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("left"), F.lit(0).alias("c"))
        return let(F.sort_array(both), lambda x: F.struct(
            F.lit(n).alias("n"), F.aggregate(x, none, fold)["c"].cast("bigint").alias("c"),
            *[F.size(F.filter(x, f)).cast("bigint").alias(c) for c, f in (
                ("a", lambda g: g["s"] == 0), ("b", lambda g: g["s"] == 1),
                ("na", lambda g: (g["s"] == 0) & g["g"].isNull()), ("nb", lambda g: (g["s"] == 1) & g["g"].isNull()))]))

    return bind_column(texts, "_n", F.array(*[counted(n) for n in orders])).select(*group, "_id", F.explode("_n").alias("x")).select(*group, "_id", "x.*")


def bleu(df: DataFrame, target="labels", prediction="predictions", id_col: str = "id", max_order: int = 4,
         group: list[str] = ()) -> DataFrame:
    """M3: corpus BLEU-4 (of each group), exponential smoothing, international tokenization, case kept."""
    orders = list(range(1, max_order + 1))
    g = _gram_counts(df, target, prediction, id_col, bleu_tokens, orders, group)
    # corpus lengths are the unigram totals and the row count is the number of order-1 rows,
    # so one aggregation over the counts gives every statistic (no second pass over the input)
    aggs = []
    for n in orders:
        aggs += [F.sum(F.when(F.col("n") == n, F.col("c") - F.least("na", "nb"))).alias(f"{n}_c"),
                 F.sum(F.when(F.col("n") == n, F.col("b") - F.col("nb"))).alias(f"{n}_t")]
    one = F.col("n") == 1
    aggs += [F.sum(F.when(one, F.col("a"))).alias("ref_len"), F.sum(F.when(one, F.col("b"))).alias("sys_len"), F.sum(one.cast("int")).alias("rows")]
    return _bleu_score(g.groupBy(*group).agg(*aggs), orders, group)


def _bleu_score(s: DataFrame, orders: list[int], group: list[str] = ()) -> DataFrame:
    """Closed form over a row of corpus statistics ``{n}_c``, ``{n}_t``, ``ref_len``, ``sys_len``, ``rows`` (per group)."""
    max_order = len(orders)
    s = s.select(*group, *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in s.columns if c not in group])
    # exponential smoothing: the k-th zero match count uses 1 / (2^k · total)
    log_sum = F.lit(0.0)
    zeros = F.lit(0)
    any_empty = F.lit(False)
    for n in orders:
        c, t = F.col(f"{n}_c"), F.col(f"{n}_t")
        zeros_n = zeros + F.when(c == 0, 1).otherwise(0)
        p = F.when(t == 0, F.lit(0.0)).when(c == 0, 100.0 / (F.pow(F.lit(2.0), zeros_n) * t)).otherwise(100.0 * c / t)
        log_sum = log_sum + F.when(p > 0, F.log(p)).otherwise(F.lit(-9999999999.0))
        any_empty = any_empty | (t == 0)
        zeros = zeros_n
    bp = F.when(F.col("sys_len") >= F.col("ref_len"), F.lit(1.0)) \
        .when(F.col("sys_len") > 0, F.exp(1 - F.col("ref_len") / F.col("sys_len"))).otherwise(F.lit(0.0))
    score = F.when(any_empty, F.lit(0.0)).otherwise(bp * F.exp(log_sum / max_order))
    return s.select(*group, F.lit("bleu").alias("metric"), score.alias("score"), F.col("rows").cast("bigint").alias("count"))


def bleu_multi_ref(df: DataFrame, targets="labels", prediction="predictions", id_col: str = "id",
                   max_order: int = 4) -> DataFrame:
    """M3 with several references per row (``targets``: ``ARRAY<STRING>``), the corpus form.

    A prediction gram is clipped by its largest count in any single reference;
    the reference length of a row is the one closest to the prediction length
    (the shorter on ties).  References are exploded with their index, counted
    per (row, reference, n, gram), reduced by ``max`` per (row, n, gram) and
    joined to the prediction counts on that key — all partial-aggregated
    shuffles; no reference list is ever collected.
    """
    orders = list(range(1, max_order + 1))
    base = df.select(_c(id_col).alias("_id"), F.transform(_c(targets), bleu_tokens).alias("_refs"),
                     bleu_tokens(prediction).alias("_tp"))
    empty = F.array().cast("array<string>")

    def grams_of(toks, a, b):
        return let(toks, lambda tk: F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b"),
                                                         F.when(F.size(tk) >= n, ngrams(tk, n)).otherwise(empty).alias("g"))
                                               for n in orders]))

    refs = base.select("_id", F.posexplode("_refs").alias("_k", "_r")) \
        .select("_id", "_k", F.explode(grams_of(F.col("_r"), 1, 0)).alias("x")) \
        .select("_id", "_k", "x.n", F.explode("x.g").alias("gram")) \
        .groupBy("_id", "_k", "n", "gram").agg(F.count(F.lit(1)).alias("a")) \
        .groupBy("_id", "n", "gram").agg(F.max("a").alias("a"))
    pred = base.select("_id", F.explode(grams_of(F.col("_tp"), 0, 1)).alias("x")) \
        .select("_id", "x.n", F.explode("x.g").alias("gram")) \
        .groupBy("_id", "n", "gram").agg(F.count(F.lit(1)).alias("b"))
    g = pred.join(refs, ["_id", "n", "gram"], "left").fillna(0, ["a"])
    aggs = []
    for n in orders:
        aggs += [F.sum(F.when(F.col("n") == n, F.least("a", "b")).otherwise(0)).alias(f"{n}_c"),
                 F.sum(F.when(F.col("n") == n, F.col("b")).otherwise(0)).alias(f"{n}_t")]
    counts = g.agg(*aggs)
    sys_len = F.size("_tp")
    closest = F.array_min(F.transform("_refs", lambda r: F.struct(F.abs(F.size(r) - sys_len).alias("d"),
                                                                  F.size(r).alias("len"))))["len"]
    lens = base.agg(F.sum(closest).alias("ref_len"), F.sum(sys_len).alias("sys_len"),
                    F.count(F.lit(1)).alias("rows"))
    # both sides are one-row aggregates: stack them and fold into one row
    stats = counts.unionByName(lens, allowMissingColumns=True)
    return _bleu_score(stats.agg(*[F.max(c).alias(c) for c in stats.columns]), orders)


def rouge_tokens(text, ascii_only: bool = False) -> Column:
    """ROUGE tokenization: lowercase; Unicode letters/digits (``ascii_only`` keeps [a-z0-9] as rouge_score)."""
    t = F.lower(_c(text))
    pat = "[^a-z0-9]+" if ascii_only else r"[^\p{L}\p{N}]+"
    return F.filter(F.split(t, pat, -1), lambda w: w != F.lit(""))


def _rouge_n_rows(df: DataFrame, target, prediction, id_col: str, orders, ascii_only: bool, group: list[str] = ()) -> DataFrame:
    """F-measure per row and order: ``(*group, _id, metric, f)``."""
    # every (row, n) has its counts, so no grid join is needed
    rows = _gram_counts(df, target, prediction, id_col, lambda t: rouge_tokens(t, ascii_only), list(orders), group) \
        .withColumnsRenamed({"c": "o", "a": "rt", "b": "rp"})
    prec = _ratio(F.col("o"), F.col("rp"))
    rec = _ratio(F.col("o"), F.col("rt"))
    f = F.when(F.col("o") == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
    return rows.select(*group, "_id", F.concat(F.lit("rouge"), F.col("n").cast("string")).alias("metric"), f.alias("f"))


def rouge_n(df: DataFrame, target="labels", prediction="predictions", id_col: str = "id", orders=(1, 2),
            ascii_only: bool = False, group: list[str] = ()) -> DataFrame:
    """M4 (rouge1, rouge2): per-row n-gram overlap F-measure, mean × 100."""
    rows = _rouge_n_rows(df, target, prediction, id_col, orders, ascii_only, group)
    return rows.groupBy(*group, "metric").agg((F.avg("f") * 100).alias("score"), F.count(F.lit(1)).cast("bigint").alias("count"))


def _lcs_union_fscore(ref: str, pred: str, ascii_only: bool) -> float:
    """Summary-level LCS (ROUGE-Lsum) for one pair; NumPy DP per sentence pair."""
    import re

    import numpy as np

    pat = re.compile(r"[^a-z0-9]+") if ascii_only else re.compile(r"[\W_]+")

    def toks(s):
        return [w for w in pat.split(s.lower()) if w]

    r_sents = [toks(s) for s in ref.replace(" . ", " .\n").split("\n")]
    p_sents = [toks(s) for s in pred.replace(" . ", " .\n").split("\n")]
    r_sents = [s for s in r_sents if s]
    p_sents = [s for s in p_sents if s]
    r_len = sum(len(s) for s in r_sents)
    p_len = sum(len(s) for s in p_sents)
    if r_len == 0 or p_len == 0:
        return 0.0
    from collections import Counter

    r_cnt = Counter(w for s in r_sents for w in s)
    p_cnt = Counter(w for s in p_sents for w in s)
    hits = 0
    for rs in r_sents:
        union: set[int] = set()
        for ps in p_sents:
            m, n = len(rs), len(ps)
            code = {w: k for k, w in enumerate(dict.fromkeys(ps))}
            words = np.array([code[w] for w in ps])
            dp = np.zeros((m + 1, n + 1), dtype=np.int32)
            for i in range(1, m + 1):
                prev = dp[i - 1]
                # one row at a time: extend on a match, else the best so far from above or the left
                dp[i, 1:] = np.maximum.accumulate(np.where(words == code.get(rs[i - 1], -1), prev[:-1] + 1, prev[1:]))
            i, j = m, n
            while i > 0 and j > 0:
                if rs[i - 1] == ps[j - 1]:
                    union.add(i - 1)
                    i -= 1
                    j -= 1
                elif dp[i - 1, j] >= dp[i, j - 1]:
                    i -= 1
                else:
                    j -= 1
        for k in sorted(union):
            w = rs[k]
            if r_cnt[w] > 0 and p_cnt[w] > 0:
                hits += 1
                r_cnt[w] -= 1
                p_cnt[w] -= 1
    if hits == 0:
        return 0.0
    prec, rec = hits / p_len, hits / r_len
    return 2 * prec * rec / (prec + rec)


def _lsum(target, prediction, ascii_only: bool) -> Column:
    import pandas as pd

    @F.pandas_udf(T.DoubleType())
    def lsum(r: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([_lcs_union_fscore(a or "", b or "", ascii_only) for a, b in zip(r, p)])

    return lsum(_c(target), _c(prediction))


def rouge_lsum(df: DataFrame, target="labels", prediction="predictions", ascii_only: bool = False, group: list[str] = ()) -> DataFrame:
    """M4 (rougeLsum): summary-level LCS F-measure per row in a pandas UDF, mean × 100."""
    rows = df.select(*group, _lsum(target, prediction, ascii_only).alias("_f"))
    return _result(rows, "rougeLsum", F.avg("_f") * 100, F.count(F.lit(1)), group)


ROUGE_KEYS = ("rouge1", "rouge2", "rougeLsum")


def rouge_rows(df: DataFrame, target="labels", prediction="predictions", id_col: str = "id", keys=ROUGE_KEYS, ascii_only: bool = False) -> DataFrame:
    """One row per input row: ``_id`` and an F-measure column per key (``rouge<n>`` or ``rougeLsum``).  Ids are unique."""
    orders = [int(k[5:]) for k in keys if k != "rougeLsum"]
    rows = _rouge_n_rows(df, target, prediction, id_col, orders, ascii_only) if orders else None
    if "rougeLsum" in keys:
        long = df.select(_c(id_col).alias("_id"), F.lit("rougeLsum").alias("metric"), _lsum(target, prediction, ascii_only).alias("f"))
        rows = long if rows is None else rows.unionByName(long)
    return rows.groupBy("_id").agg(*[F.max(F.when(F.col("metric") == k, F.col("f"))).alias(k) for k in keys])


def poisson_levels(digits: int = 8) -> list[str]:
    """Hex words up to which a uniform word of ``digits`` hex digits gives a Poisson(1) weight of 0, 1, 2, …:
    the weight is the number of levels at or below the word."""
    out, total, term = [], 0.0, math.exp(-1)
    for k in range(1, 64):
        total += term
        level = math.floor(total * 16 ** digits)
        if level >= 16 ** digits:
            break
        out.append(f"{level:0{digits}x}")
        term /= k
    return list(dict.fromkeys(out))


def bootstrap(rows: DataFrame, keys: list[str], id_col: str = "_id", replicates: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Bootstrap of column means: ``(metric, low, score, high, count)`` per key, scores × 100.

    A replicate weighs every row by a Poisson(1) draw, the distributed form of drawing ``count`` rows with
    replacement.  Draws come from the md5 of ``seed:chunk:id`` (eight hex digits each, four replicates a digest), so
    reruns and retries agree and no row sees another.  Each task adds up its rows per replicate; the score is the
    median over the replicates' means, low and high the bounds of the middle ``level``.  A replicate without any
    weight is left out.  Work is rows × replicates; ids are unique.
    """
    levels = poisson_levels()
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_chunk").cast("string"), F.col("_key")))

    def weight(word: Column) -> Column:
        out = F.lit(len(levels))
        for k in range(len(levels) - 1, -1, -1):
            out = F.when(word < levels[k], F.lit(k)).otherwise(out)
        return out

    e = rows.select(F.col(id_col).cast("string").alias("_key"), *keys, F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))).alias("_chunk"))
    e = e.withColumn("_digest", digest)
    words = F.array(*[F.struct((F.col("_chunk") * 4 + i).alias("_b"), weight(F.substring("_digest", 8 * i + 1, 8)).alias("_w")) for i in range(4)])
    e = e.select(*keys, F.explode(words).alias("_x")).select(*keys, "_x._b", "_x._w").where((F.col("_w") > 0) & (F.col("_b") < replicates))
    means = e.groupBy("_b").agg(*[(F.sum(F.col("_w") * F.col(k)) / F.sum(F.when(F.col(k).isNotNull(), F.col("_w")))).alias(k) for k in keys])
    at = [(1 - level) / 2, 0.5, (1 + level) / 2]
    stats = means.agg(*[F.percentile(k, F.array(*[F.lit(x) for x in at])).alias(k) for k in keys])
    counts = rows.agg(*[F.count(k).alias(k) for k in keys])
    both = stats.select(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("q")) for k in keys]).alias("s"), F.lit(None).cast("array<bigint>").alias("n")) \
        .unionByName(counts.select(F.array(*[F.col(k).cast("bigint") for k in keys]).alias("n")), allowMissingColumns=True) \
        .agg(F.max_by("s", F.col("s").isNotNull()).alias("s"), F.max_by("n", F.col("n").isNotNull()).alias("n"))
    x = both.select(F.explode(F.arrays_zip("s", "n")).alias("x"))
    return x.select(F.col("x.s.metric").alias("metric"), *[(F.get("x.s.q", i) * 100).alias(c) for i, c in enumerate(("low", "score", "high"))],
                    F.col("x.n").alias("count"))


def rouge_bootstrap(df: DataFrame, target="labels", prediction="predictions", id_col: str = "id", keys=ROUGE_KEYS, ascii_only: bool = False,
                    replicates: int = 1000, seed: int = 0) -> DataFrame:
    """M4 as a bootstrap: median and 95 % interval of the mean F-measure of each key."""
    return bootstrap(rouge_rows(df, target, prediction, id_col, keys, ascii_only), list(keys), replicates=replicates, seed=seed)


# ---------------------------------------------------------------- M12 M13

def token_tags_to_char_tags(pred, c2t, tag_list: list[str]) -> Column:
    """Char gets its token's predicted tag; for ``B`` only the token's first char keeps ``B``.

    Null or out-of-range token index → ``O``.
    """
    tags = F.array(*[F.lit(t) for t in tag_list])
    outside = F.lit(tag_list.index("O"))

    def one(z, pr):
        tok, prev = z["tok"], z["prev"]
        p = F.get(pr, tok)
        name = F.get(tags, p)
        first = prev.isNull() | (prev != tok)
        i_id = (F.array_position(tags, F.concat(F.lit("I"), name.substr(F.lit(2), F.length(name)))) - 1).cast("int")
        return F.when(tok.isNull() | p.isNull() | name.isNull() | (name == "O"), outside) \
            .when(name.startswith("B") & ~first, i_id) \
            .otherwise(p)

    # each char is paired with the previous char's token; the prediction array is bound once
    return let_many({"pr": _c(pred), "ct": _c(c2t)}, lambda b: F.transform(
        F.arrays_zip(b["ct"].alias("tok"), shift_right(b["ct"], F.lit(None).cast("int")).alias("prev")),
        lambda z: one(z, b["pr"])))


def char_entity_f1(df: DataFrame, char_tags: str, pred_char_tags: str, tag_list: list[str], id_col: str = "id",
                   compat: bool = False, group: list[str] = ()) -> DataFrame:
    """Per-sentence macro F1 over char tags, weight 0 on chars whose true tag is ``O``.

    Labels are the union of true and predicted tags of the sentence (``O``
    included, as the library does).  Default score = mean over sentences that
    hold an entity char; ``compat`` divides the summed sentence scores by the
    number of entity chars, as upstream.
    """
    o = tag_list.index("O")
    base = df.select(*group, _c(id_col).alias("_id"), F.explode(F.arrays_zip(_c(char_tags).alias("t"), _c(pred_char_tags).alias("p"))).alias("z"))
    # equal pairs of tags are counted first, then each pair counts for the label of either side
    pairs = base.groupBy(*group, "_id", F.col("z.t").alias("t"), F.col("z.p").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.where(F.col("t").isNotNull())
    n = F.when(F.col("t") != o, F.col("n")).otherwise(0)
    same, zero = F.col("t").eqNullSafe(F.col("p")), F.lit(0).cast("long")  # a char without a prediction is a miss

    def side(lab, tp, fp, fn, ent):
        return F.struct(F.col(lab).alias("lab"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ent.alias("ent"))

    sides = F.array(side("t", F.when(same, n).otherwise(0), zero, F.when(~same, n).otherwise(0), n),
                    side("p", zero, F.when(~same, n).otherwise(0), zero, zero))
    per_lab = pairs.select(*group, "_id", F.explode(sides).alias("x")).select(*group, "_id", "x.*").where(F.col("lab").isNotNull()) \
        .groupBy(*group, "_id", "lab").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "ent")])
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, F.lit(0.0)) \
        .otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    per_sent = per_lab.groupBy(*group, "_id").agg(F.avg(f1).alias("macro"), F.sum("ent").alias("ent")).where(F.col("ent") > 0)
    if compat:
        return _result(per_sent, "char_f1", _ratio(F.sum(F.col("macro") * 100), F.sum("ent")), F.sum("ent"), group)
    return _result(per_sent, "char_f1", F.avg("macro") * 100, F.count(F.lit(1)), group)


# ---------------------------------------------------------------- M14-M16

def log_softmax_at(logits, label) -> Column:
    def body(b):
        a, m = b["a"], b["m"]
        lse = m + F.log(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
        return F.get(a, _c(label)) - lse

    return let_many({"a": _c(logits), "m": F.array_max(_c(logits))}, body)


def ce_loss(df: DataFrame, logits="logits", label="labels", group: list[str] = ()) -> DataFrame:
    """Mean cross-entropy (stable log-sum-exp)."""
    return _result(df, "ce_loss", F.avg(-log_softmax_at(logits, label)), F.count(F.lit(1)), group)


def token_ce_loss(df: DataFrame, logits="logits", labels="labels", mask: str = "attention_mask") -> DataFrame:
    """M14 token form: mean over positions whose mask is 1."""
    z = F.arrays_zip(_c(logits).alias("l"), _c(labels).alias("y"), _c(mask).alias("m"))
    e = df.select(F.explode(z).alias("z")).where(F.col("z.m") == 1)
    return _result(e, "ce_loss", F.avg(-log_softmax_at(F.col("z.l"), F.col("z.y"))), F.count(F.lit(1)))


def mse_loss(df: DataFrame, prediction="predictions", target="labels", group: list[str] = ()) -> DataFrame:
    """Mean squared error."""
    d = _c(prediction).cast("double") - _c(target).cast("double")
    return _result(df, "mse_loss", F.avg(d * d), F.count(F.lit(1)), group)


def bce_loss(df: DataFrame, logits="logits", targets="targets") -> DataFrame:
    """BCE with logits over all elements, stable form."""
    z = F.arrays_zip(_c(logits).alias("x"), _c(targets).alias("y"))
    e = df.select(F.explode(z).alias("z"))
    x, y = F.col("z.x").cast("double"), F.col("z.y").cast("double")
    v = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return _result(e, "bce_loss", F.avg(v), F.count(F.lit(1)))


# ---------------------------------------------------------------- M17 M18 M20

def meter_average(per_batch: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per-batch ``(metric, score, count)`` → Σ score·count / Σ count per metric, over batches that have a score."""
    g = [*(group or []), "metric"]
    count = F.sum(F.when(F.col("score").isNotNull(), F.col("count")).otherwise(0))
    return per_batch.groupBy(*g).agg(_ratio(F.sum(F.col("score") * F.col("count")), count).alias("score"), count.cast("bigint").alias("count"))


def batched(df: DataFrame, batch_col: str, metric_fn=None, **kw) -> DataFrame:
    """Per-batch scores ``(batch, metric, score, count)``; ``metric_fn`` is a metric with ``group`` (accuracy by default).

    A batch without any weight (no positive row, no entity) has count 0 or no row and does not enter the meter.
    """
    return (metric_fn or accuracy)(df, group=[batch_col], **kw)


def metric_history(scores: DataFrame, task: str, tag: str, step_col: str = "step") -> DataFrame:
    """History rows ``(task, tag, metric, step, score, count, line)``; ``line`` = ``tag/metric: %.3f``."""
    return scores.select(
        F.lit(task).alias("task"), F.lit(tag).alias("tag"), "metric", F.col(step_col).cast("bigint").alias("step"),
        "score", "count",
        F.format_string("%s/%s: %.3f", F.lit(tag), F.col("metric"), F.col("score")).alias("line"))
