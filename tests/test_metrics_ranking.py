"""Metrics, ranks and positional indexes against small Python/NumPy references."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators import metrics as M
from textloom.operators import select as W
from textloom.operators.ranking import average_rank, global_index, group_index


def _score(df):
    r = df.collect()[0]
    return r["score"], r["count"]


def test_accuracy_and_micro_f1(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (0, 2)], "labels int, predictions int")
    assert _score(M.accuracy(df)) == (50.0, 4)
    s, c = _score(M.micro_f1_nonzero(df))
    assert (s, c) == (50.0, 2)
    none = spark.createDataFrame([(0, 1), (0, 0)], "labels int, predictions int")
    assert _score(M.micro_f1_nonzero(none)) == (None, 0)


def _mcc_np(t, p):
    k = sorted(set(t) | set(p))
    c = np.zeros((len(k), len(k)))
    for a, b in zip(t, p):
        c[k.index(a), k.index(b)] += 1
    tk, pk, s, d = c.sum(1), c.sum(0), c.sum(), np.trace(c)
    den = math.sqrt((s * s - (pk * pk).sum()) * (s * s - (tk * tk).sum()))
    return 0.0 if den == 0 else (d * s - (pk * tk).sum()) / den


def test_matthews(spark):
    rnd = random.Random(3)
    t = [rnd.randrange(4) for _ in range(300)]
    p = [x if rnd.random() < 0.6 else rnd.randrange(4) for x in t]
    df = spark.createDataFrame(list(zip(t, p)), "labels int, predictions int")
    assert _score(M.matthews(df))[0] == pytest.approx(_mcc_np(t, p))
    const = spark.createDataFrame([(1, 1), (1, 1)], "labels int, predictions int")
    assert _score(M.matthews(const))[0] == 0.0


def test_pearson_constant_is_null_and_spearman_matches_pandas(spark):
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "labels double, predictions double")
    assert _score(M.pearson(const))[0] is None
    rnd = random.Random(5)
    t = [float(rnd.randrange(10)) for _ in range(500)]
    p = [x + rnd.randrange(5) for x in t]
    df = spark.createDataFrame(list(zip(t, p)), "labels double, predictions double")
    want = pd.Series(t).rank().corr(pd.Series(p).rank()) * 100
    assert _score(M.spearman(df, partitions=4))[0] == pytest.approx(want)


def test_average_rank_with_hot_value(spark):
    vals = [7.0] * 400 + [float(i) for i in range(100)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = {r["v"]: r["rank"] for r in average_rank(df, "v", partitions=5).collect()}
    want = pd.Series(vals).rank().groupby(vals).first().to_dict()
    assert got == pytest.approx(want)


def test_global_and_group_index_with_skew(spark):
    rows = [("hot", i) for i in range(600)] + [(f"g{i % 7}", i) for i in range(600, 700)]
    df = spark.createDataFrame(rows, "g string, k long")
    gi = {r["k"]: r["idx"] for r in global_index(df, ["k"], partitions=6).collect()}
    assert gi == {k: i for i, k in enumerate(sorted(k for _, k in rows))}
    gr = group_index(df, ["g"], ["k"], partitions=6).collect()
    by = {}
    for g, k in sorted(rows):
        by.setdefault(g, []).append(k)
    for r in gr:
        assert r["idx"] == sorted(by[r["g"]]).index(r["k"])


def _char_f1_py(t, p):
    same = sum((Counter(t) & Counter(p)).values())
    if same == 0:
        return 0.0
    pr, rc = same / len(p), same / len(t)
    return 2 * pr * rc / (pr + rc)


def test_char_f1(spark):
    pairs = [("1", "hello", "help"), ("2", "abc", "xyz"), ("3", "안녕하세요", "안녕")]
    df = spark.createDataFrame(pairs, "id string, labels string, predictions string")
    want = 100 * np.mean([_char_f1_py(t, p) for _, t, p in pairs])
    assert _score(M.char_f1(df))[0] == pytest.approx(want)


def test_bleu_identical_and_rouge(spark):
    df = spark.createDataFrame([("1", "the cat sat on the mat .", "the cat sat on the mat .")],
                               "id string, labels string, predictions string")
    assert _score(M.bleu(df))[0] == pytest.approx(100.0)
    r = {x["metric"]: x["score"] for x in M.rouge_n(df).collect()}
    assert r == {"rouge1": pytest.approx(100.0), "rouge2": pytest.approx(100.0)}
    assert _score(M.rouge_lsum(df))[0] == pytest.approx(100.0)


def test_bleu_multi_ref(spark):
    one = spark.createDataFrame([("1", "the cat is on the mat", "the cat sat on the mat"),
                                 ("2", "a b c d e", "a b c d f")], "id string, labels string, predictions string")
    multi = one.withColumn("refs", F.array("labels"))
    assert _score(M.bleu_multi_ref(multi, "refs", "predictions"))[0] == pytest.approx(_score(M.bleu(one))[0])
    hit = one.withColumn("refs", F.array("labels", "predictions"))
    assert _score(M.bleu_multi_ref(hit, "refs", "predictions"))[0] == pytest.approx(100.0)


def test_rouge_lsum_hand_case(spark):
    # reference 2 sentences, prediction 1 sentence; union LCS hits = 3 of 4 reference tokens
    df = spark.createDataFrame([("a b\nc d", "a c d")], "labels string, predictions string")
    prec, rec = 3 / 3, 3 / 4
    assert _score(M.rouge_lsum(df))[0] == pytest.approx(100 * 2 * prec * rec / (prec + rec))


def test_token_accuracy_ragged_compat(spark):
    df = spark.createDataFrame([([1, 2, 0, 0], [1, 3, 0], [1, 1, 0, 0])],
                               "labels array<int>, predictions array<int>, m array<int>")
    assert _score(M.token_accuracy_ragged(df, mask="m"))[0] == pytest.approx(50.0)
    assert _score(M.token_accuracy_ragged(df, mask="m", compat=True))[0] == pytest.approx(100 * 2 / 3)


def test_losses(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2, [0.0, 1.0, 0.0])], "logits array<double>, labels int, t array<double>")
    lse = math.log(sum(math.exp(x) for x in [1, 2, 3]))
    assert _score(M.ce_loss(df))[0] == pytest.approx(lse - 3)
    bce = np.mean([max(x, 0) - x * y + math.log1p(math.exp(-abs(x))) for x, y in zip([1, 2, 3], [0, 1, 0])])
    assert _score(M.bce_loss(df, "logits", "t"))[0] == pytest.approx(bce)


def test_fused_pools_equal_separate_pools(spark):
    from textloom.operators import vectors as V

    rows = [(s, p, [float(s + p), float(p * 2), 1.5], 1 if p % 4 != 3 else 0) for s in range(3) for p in range(6)]
    v = spark.createDataFrame(rows, "seq int, pos int, vec array<double>, mask int")
    sep = V.concat_pool([V.start_pool(v), V.span_pool(v, 1, 4), V.masked_pool(v)])
    fused = V.fused_pools(v, span=(1, 4), at=0)
    a = sorted((r["seq"], r["dim"], round(r["value"], 9)) for r in sep.collect())
    b = sorted((r["seq"], r["dim"], round(r["value"], 9)) for r in fused.collect())
    assert a == b and len(a) == 3 * 9


def test_best_so_far(spark):
    h = spark.createDataFrame([("t", "m", 0, 1.0), ("t", "m", 1, 3.0), ("t", "m", 2, 3.0), ("t", "m", 3, 2.0)],
                              "task string, metric string, step int, score double")
    gb = [r["is_best"] for r in W.greater_is_best(h).orderBy("step").collect()]
    lb = [r["is_best"] for r in W.less_is_best(h).orderBy("step").collect()]
    assert gb == [True, True, False, False]
    assert lb == [True, False, False, False]
    assert W.best_step(h).collect()[0]["best_step"] == 1


def test_index_is_exact_with_payload_columns(spark):
    """Positions over rows with payload: a million rows, a hot group, several bucket counts."""
    from textloom.operators.ranking import average_rank, global_index, group_index
    from textloom.sources.sharding import assign_shards

    n = 1_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("id"), F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 10).alias("g"),
                               F.md5(F.col("id").cast("string")).alias("payload"))
    for parts in (4, 50):
        idx = global_index(df, ["id"], "pos", parts)
        assert idx.agg(F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.sum((F.col("pos") != F.col("id")).cast("int"))).first() == (n, 0, n - 1, 0)
    g = group_index(df, ["g"], ["id"], "pos", 16).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("m"))
    assert all(r.n == r.d == r.m + 1 for r in g.collect())
    s = assign_shards(df, ["id"], epoch=1, world_size=3, batch_size=32, partitions=16)
    got = s.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("m")).collect()
    assert sum(r.n for r in got) == n and all(r.n == r.d == r.m + 1 for r in got)
    r = average_rank(df, "id", partitions=16)
    assert r.where(F.col("rank") != F.col("id") + 1).count() == 0 and r.count() == n


def test_slices_share_no_row(spark):
    from textloom.sources.reader import slice_split

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    for parts in (4, 8, 200):
        a, b = slice_split(docs, ["doc_id"], None, 90, parts), slice_split(docs, ["doc_id"], 90, None, parts)
        assert (a.count(), b.count()) == (9000, 1000)
        assert a.select("doc_id", "text").join(b.select("doc_id"), "doc_id", "left_semi").count() == 0


def test_char_f1_counts_rows_with_null_text(spark):
    df = spark.createDataFrame([(1, "ab", "ab"), (2, None, "x")], "id int, labels string, predictions string")
    r = M.char_f1(df).first()
    assert (r["score"], r["count"]) == (50.0, 2)


def test_buckets_follow_the_size_and_no_job_runs_while_planning(spark, monkeypatch):
    from textloom.operators import ranking as R
    from textloom.sources import reader, sharding

    monkeypatch.setattr(R, "_ROWS", 50)
    df = spark.range(4000, numPartitions=5).select((F.col("id") * 7919 % 4001).alias("k"), (F.col("id") % 3).alias("g"))
    sc = spark.sparkContext
    sc.setJobGroup("plan-only", "")
    bucketed = R._bucketed(df, ["k"], 4)
    plans = [global_index(df, ["k"], "i", 4), group_index(df, ["g"], ["k"], "i", 4), average_rank(df, "k", "r", 4),
             reader.slice_split(df, ["k"], 10, 90, 4), sharding.assign_shards(df, ["k"], 1, 2, 8, partitions=4)]
    assert len(sc.statusTracker().getJobIdsForGroup("plan-only")) == 0
    sc.setJobGroup("run", "")
    sizes = [r["count"] for r in bucketed.groupBy("_b").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 600  # 4,000 rows, 50 a bucket
    keys = sorted(r.k for r in df.collect())
    assert {r.k: r.i for r in plans[0].collect()} == {k: i for i, k in enumerate(keys)}
    assert sorted(r.k for r in plans[3].collect()) == keys[400:3600]
    assert len({(r.shard, r.pos) for r in plans[4].collect()}) == 4000
    assert [r.k for r in reader.slice_split(df, ["k"], None, 0).collect()] == [] == reader.slice_split(df, ["k"], 100, None).collect()
    assert reader.slice_split(df, ["k"], 0, 100).count() == 4000
    assert reader.slice_split(df.where("false"), ["k"], 10, 90).count() == 0


def test_grouped_metrics_equal_the_metric_of_each_group(spark):
    rnd = random.Random(11)
    words = "the cat sat on a mat . dog ran, far\nhome".split(" ")
    rows = []
    for i in range(40):
        a = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))
        b = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))
        n = rnd.randint(0, 8)
        ct = [rnd.choice([0, 1, 2]) if i % 4 != 3 else 2 for _ in range(n)]
        rows.append((i, i % 4, a, b, rnd.randrange(3), rnd.randrange(3), ct, [rnd.choice([0, 1, 2]) for _ in range(n)]))
    df = spark.createDataFrame(rows, "id int, g int, t string, p string, x int, y int, ct array<int>, cp array<int>")
    tags = ["B-A", "I-A", "O"]
    calls = [(M.accuracy, ("x", "y"), {}), (M.micro_f1_nonzero, ("x", "y"), {}), (M.relation_f1, ("x", "y"), {}), (M.bleu, ("t", "p"), {}),
             (M.rouge_n, ("t", "p"), {}), (M.rouge_lsum, ("t", "p"), {}), (M.char_f1, ("t", "p"), {}), (M.token_accuracy, ("ct", "cp"), {}),
             (M.char_entity_f1, ("ct", "cp", tags), {}), (M.char_entity_f1, ("ct", "cp", tags), {"compat": True})]
    for fn, args, kw in calls:
        got = {(r["g"], r["metric"]): (r["score"], r["count"]) for r in fn(df, *args, group=["g"], **kw).collect()}
        for g in range(4):
            for r in fn(df.where(F.col("g") == g), *args, **kw).collect():
                if r["count"]:
                    assert got[(g, r["metric"])] == pytest.approx((r["score"], r["count"])), (fn.__name__, g)
                else:
                    assert got.get((g, r["metric"]), (None, 0))[1] == 0


def test_bootstrap_equals_numpy_and_is_stable(spark):
    import hashlib

    levels = M.poisson_levels()
    assert levels == sorted(levels) and int(levels[0], 16) == math.floor(math.exp(-1) * 16 ** 8)
    rnd = random.Random(12)
    values = {f"r{i}": rnd.random() for i in range(60)}
    df = spark.createDataFrame([(k, v, v * v) for k, v in values.items()], "_id string, a double, b double")
    means = {"a": [], "b": []}
    for b in range(102):
        w = {}
        for k in values:
            word = hashlib.md5(f"7:{b // 4}:{k}".encode()).hexdigest()[8 * (b % 4):8 * (b % 4) + 8]
            w[k] = sum(word >= x for x in levels)
        assert 20 < sum(w.values()) < 120
        for c, f in (("a", 1), ("b", 2)):
            means[c].append(sum(w[k] * v ** f for k, v in values.items()) / sum(w.values()))
    for parts in (1, 7):
        got = {r["metric"]: r for r in M.bootstrap(df.repartition(parts), ["a", "b"], replicates=102, seed=7).collect()}
        for c, xs in means.items():
            assert [got[c]["low"], got[c]["score"], got[c]["high"]] == pytest.approx([100 * np.quantile(xs, q) for q in (0.025, 0.5, 0.975)])
            assert got[c]["count"] == 60
    assert {r["metric"]: (r["score"], r["count"]) for r in M.bootstrap(df.limit(0), ["a"], replicates=8).collect()} == {"a": (None, 0)}


def test_rouge_bootstrap_keys(spark):
    df = spark.createDataFrame([(i, "a b c d", "a b x d" if i % 2 else "a b c d") for i in range(30)], "id int, labels string, predictions string")
    got = {r["metric"]: r for r in M.rouge_bootstrap(df, keys=("rouge2", "rougeLsum"), replicates=200).collect()}
    assert set(got) == {"rouge2", "rougeLsum"}
    assert all(r["low"] <= r["score"] <= r["high"] and r["count"] == 30 for r in got.values())
    assert got["rougeLsum"]["score"] == pytest.approx(87.5, abs=5)


def test_grams_stay_in_their_rows(spark):
    """No gram is a key of an aggregation, and rows of one id count together."""
    rows = [(1, "a b a", "a a c"), (1, "b", "b a"), (None, "", None), (2, "x y", "x y")]
    df = spark.createDataFrame(rows, "id long, labels string, predictions string")
    g = {(r["_id"], r["n"]): (r["c"], r["a"], r["b"]) for r in M._gram_counts(df, "labels", "predictions", "id", M.bleu_tokens, [1, 2]).collect()}
    assert g == {(1, 1): (3, 4, 5), (1, 2): (1, 3, 3), (None, 1): (1, 1, 1), (None, 2): (1, 1, 1), (2, 1): (2, 2, 2), (2, 2): (1, 1, 1)}
    assert "gram" not in M.bleu(df)._jdf.queryExecution().executedPlan().toString()


def test_map_batches_bounds_its_batches(spark):
    """Without a batch size a call gets rows of bounded size, not the whole Arrow batch."""
    from textloom.operators import rows as R

    df = spark.range(3000).selectExpr("id", "repeat('x', 4000) AS text").coalesce(1)
    out = R.map_batches(df, lambda b: pd.DataFrame({"n": [len(b)]}), "n long").collect()
    assert sum(r["n"] for r in out) == 3000 and max(r["n"] for r in out) * 4000 <= R.BATCH_BYTES
