import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality as Q
from textloom.session import materialise, read_table

SF, SF_LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def features_of(spark, sf):
    docs = read_table(spark, sf, "documents").repartition(8)
    made = F.arrow_udf(Q._features, "content binary, meta binary")(F.coalesce("text", F.lit("")), "source", "lang")
    rows = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("doc_id", "text", "source", "lang").alias("__key"), made.alias("m"))
    rows = rows.select("__id", "__key", F.col("m.content").alias("__content"), F.col("m.meta").alias("__meta"))
    return materialise(rows, "features")


@pytest.fixture(scope="module")
def stored(spark):
    rows = features_of(spark, SF)
    return rows.unionByName(rows.limit(40)).repartition(7)  # some rows repeat


def brute_surest(table, training, known):
    """The same choice over one local table."""
    best = {}
    for teacher, pupil, label, most in training.wanted():
        z = {}
        for r in table:
            if r["__id"] in known or r["__key"] in training.given[pupil]:
                continue
            x = Q._matrix(teacher, [bytes(r["__meta" if teacher else "__content"])])
            raw = round(float(x[0].astype(np.float64) @ training.models[teacher].weight.astype(np.float64) + training.models[teacher].bias), 6)
            if (raw if label else -raw) > Q.SURE:
                z[r["__key"]] = raw if label else -raw
        chosen = sorted(z, key=lambda k: (-z[k], k))[:most]
        if chosen:
            best[(pupil, label)] = sorted(chosen)
    return best


def test_pseudo_labels_come_from_all_unlabelled_rows(spark, stored):
    labels = read_table(spark, SF, "labels").filter("quality is not null")
    known = {r.doc_id: float(r.quality > 0) for r in labels.filter("doc_id % 3 = 0").collect()}
    table = stored.collect()
    own = [r for r in table if r["__id"] in known]
    y = np.array([known[r["__id"]] for r in own])
    training = Q.CoTraining([Q._matrix(v, [bytes(r[c]) for r in own]) for v, c in enumerate(("__content", "__meta"))], y, per_round=30)
    frame = labels.filter("doc_id % 3 = 0").select("doc_id")
    first = Q.surest(stored, training, frame)
    assert first == brute_surest(table, training, known) and sum(map(len, first.values())) > 20
    features = {r["__key"]: r for r in table}
    for (pupil, label), keys in sorted(first.items()):
        training.give(pupil, label, keys, Q._matrix(pupil, [bytes(features[k]["__meta" if pupil else "__content"]) for k in keys]))
    training.fit()
    second = Q.surest(stored, training, frame)
    assert second == brute_surest(table, training, known)
    assert not any(set(second.get(k, [])) & set(v) for k, v in first.items())


def log_loss(z, goal):
    p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-12, 1 - 1e-12)
    return float(-np.where(goal, np.log(p), np.log(1 - p)).mean())


def test_the_exchange_changes_and_helps_the_models(spark):
    """An eighth of the labels teaches, the rest judges: both views together lose less after the exchange."""
    stored = features_of(spark, SF_LARGER)
    labels = read_table(spark, SF_LARGER, "labels").filter("quality is not null")
    few = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 8 == 0)
    hidden = {r.doc_id: r.quality > 0 for r in labels.join(few, "doc_id", "left_anti").collect()}
    rows = [r for r in stored.collect() if r["__id"] in hidden]
    views = [Q._matrix(v, [bytes(r[c]) for r in rows]) for v, c in enumerate(("__content", "__meta"))]
    goal = np.array([hidden[r["__id"]] for r in rows])
    losses, weights = [], []
    for rounds in (0, 4):
        models = Q.train(stored, few, rounds=rounds, per_round=40)
        weights.append(np.concatenate([m.weight for m in models]))
        losses.append([log_loss(m.odds(x), goal) for m, x in zip(models, views)])
    assert not np.allclose(*weights)
    assert losses[1][0] < losses[0][0] and sum(losses[1]) < sum(losses[0])


def test_features_are_stored_without_their_zeros():
    texts = ["", "The cat sat on the mat, again.\n" * 40, "a", "x" * 3000, "h\u00e9llo w\u00f6rld " * 9]
    source, lang = [None, "web", "web", "src1", None], ["en", None, "de", "en", "en"]
    made = Q._features(pa.array(texts), pa.array(source, pa.string()), pa.array(lang, pa.string()))
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for view, want in enumerate(Q.features(np.frombuffer(b"".join(raw), np.uint8), off, source, lang)):
        want = want.astype(Q._STORED[view]).astype(np.float32)
        column = made.field(view)
        assert (Q._matrix(view, column) == want).all() and (Q._matrix(view, [r.as_py() for r in column]) == want).all()
        assert (Q._matrix(view, pa.chunked_array([column.slice(1, 2), column.slice(3)])) == want[1:]).all()
        assert Q._matrix(view, column.slice(2, 0)).shape == (0, Q.WIDTH[view])
    sizes = [len(r.as_py()) for r in made.field(0)]
    assert sizes[0] < 300 and sizes[2] < 300 and max(sizes) < 1000  # 4,104 with zeros


def test_quality_keeps_the_named_columns(spark, edge_docs, edge_rows):
    marked = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    out = Q.quality(edge_docs, marked, keep=["doc_id", "n"])
    assert out.columns == ["doc_id", "n", "quality_score", "quality_content", "quality_meta", "quality_keep"] and out.count() == len(edge_rows)
