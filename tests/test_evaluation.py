"""Inference, prepared tables, streaming preparation and whole evaluation runs on small tables."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from textloom.operators.evaluate import evaluate
from textloom.operators.inference import BagModel, named_arguments, score_batches, to_input
from textloom.plans.tasks import build_catalogue
from textloom.session import read_table
from textloom.sources import prepared as PR
from textloom.streaming.prepare import drain_prepared, prepare_stream

TASKS = {t.name: t for t in build_catalogue()}


def _echo():
    class Echo:
        """Model whose methods give back what they were called with."""

        def __init__(self):
            self.inner = self

        def forward(self, a, b, scale=1):
            return np.stack([np.asarray(a) * scale, np.asarray(b, float)], axis=1), "more"

        def pair(self, a, b):
            return {"first": np.asarray(a) + np.asarray(b), "second": None}

        def words(self, text, **others):
            assert not others
            return [t[::-1] if t is not None else None for t in text]

        def generate(self, rows, n=2):
            return [list(r)[:n] for r in rows]

        def short(self, a):
            return a[:-1]

    return Echo


Echo = _echo()  # a local class, so that it travels to the workers by value


def test_inputs_method_and_keywords(spark):
    df = spark.createDataFrame([(i, float(i), 10.0 - i, f"t{i}" if i else None, list(range(i))) for i in range(7)], "id int, a double, b double, text string, rows array<int>")
    out = {r["id"]: r for r in score_batches(df.repartition(2), Echo, ["a", "b", "missing"], constants={"scale": 2, "beams": 3}, batch_rows=2).collect()}
    assert [out[i]["predictions"] for i in range(7)] == [int(10.0 - i > 2 * i) for i in range(7)]
    assert out[3]["text"] == "t3" and len(out) == 7
    logits = score_batches(df, Echo, ["a", "b"], logit_to_id=False, out="logits", out_type="array<double>", keep=["id"]).collect()
    assert logits[3]["logits"] == [3.0, 7.0] and set(logits[0].asDict()) == {"id", "logits"}
    assert [r["a"] for r in score_batches(df, Echo, ["a", "b"], "inner.pair", out="a", out_type="double").orderBy("id").collect()] == [10.0] * 7
    words = score_batches(df, Echo, ["text", "a"], "words", out_type="string", keep=["id"]).orderBy("id").collect()
    assert [r["predictions"] for r in words[:2]] == [None, "1t"]
    made = score_batches(df, Echo, ["rows"], "generate", {"n": 3}, out_type="array<int>", keep=["id"]).orderBy("id").collect()
    assert [r["predictions"] for r in made] == [list(range(min(i, 3))) for i in range(7)]
    assert score_batches(df.limit(0), Echo, ["a", "b"]).collect() == []
    with pytest.raises(Exception, match="rows for a batch"):
        score_batches(df, Echo, ["a"], "short", out_type="double").collect()


def test_batches_as_arrays():
    import pyarrow as pa

    assert to_input(pa.array([[1, 2], [3, 4]])).tolist() == [[1, 2], [3, 4]]
    assert to_input(pa.array([[[1], [2]], [[3], [4]]])).shape == (2, 2, 1)
    assert [x.tolist() for x in to_input(pa.array([[1], [], [2, 3]]))] == [[1], [], [2, 3]]
    assert to_input(pa.array([[1], None])) == [[1], None] and to_input(pa.array([1, None])) == [1, None]
    assert named_arguments(lambda x, y=2: None, {"x": 1, "z": 3}) == {"x": 1}


def test_bag_model_generates():
    m = BagModel(classes=3, step=2)
    ids, mask = np.array([[5, 9, 14, 0]]), np.array([[1, 1, 1, 0]])
    logits, n = m.forward(ids, mask)
    assert logits.tolist() == [[sum((i * 8 + j * 3) % 11 - 5 for i in (5, 9, 14)) for j in range(3)]] and n.tolist() == [3]
    best = int(np.argmax(logits[0]))
    assert list(m.generate(ids, mask, 2)[0]) == [i for i in (5, 9, 14) if (i * 8 + best * 3) % 11 - 5 > 0][:2]


def test_prepared_once(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "prepared")
    spark.createDataFrame([(i, f"s{i % 2}") for i in range(10)], "id int, split string").write.parquet(src)

    def table():
        return spark.read.parquet(src).withColumn("x", F.col("id") * 2)

    def folders():
        return sorted(f for f in os.listdir(root) if f.startswith("data-"))

    want = sorted(map(tuple, table().collect()))
    first = PR.prepare_once(table(), root)
    assert sorted(map(tuple, first.collect())) == want and first.columns == ["id", "split", "x"] and len(folders()) == 1
    assert sorted(map(tuple, PR.prepare_once(table(), root).collect())) == want and len(folders()) == 1  # read, not written
    assert PR.await_prepared(table(), root, timeout=1).count() == 10
    # a half-written folder has no marker: nobody reads it and the table is built again
    key = PR.fingerprint(table())
    os.remove(f"{root}/{key}.json")
    with pytest.raises(TimeoutError):
        PR.await_prepared(table(), root, timeout=0.1, poll=0.05)
    assert PR.prepare_once(table(), root).count() == 10 and len(folders()) == 2
    # a marker whose data is gone is replaced
    note = json.load(open(f"{root}/{key}.json"))
    os.rename(f"{root}/{note['data']}", f"{tmp_path}/gone")
    assert PR.prepare_once(table(), root).count() == 10
    # another plan, version or input is another table; the old one stays readable
    other = PR.prepare_once(table().where("id < 5"), root)
    assert other.count() == 5 and PR.prepare_once(table(), root, version="2").count() == 10
    spark.createDataFrame([(99, "s0")], "id int, split string").write.mode("append").parquet(src)
    assert PR.prepare_once(table(), root).count() == 11 and other.count() == 5


def test_streamed_preparation_replays_and_resumes(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "run")
    conv = read_table(spark, SF_SMALL, "conversations")
    rows = conv.withColumns({"id": F.concat_ws(":", "conv_id", "turn"), "label": (F.col("turn") % 7).cast("int")})
    parts = rows.randomSplit([0.5, 0.5], 3)
    parts[0].coalesce(2).write.parquet(src)
    task, lengths = TASKS["intent"], {"inputs": 16}

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
        return drain_prepared(prepare_stream(task, stream, lengths), "intent", root)

    def plain(df):
        return sorted(tuple(map(str, r)) for r in task.apply(df, lengths).collect())

    assert sorted(tuple(map(str, r)) for r in run().collect()) == plain(parts[0])
    parts[1].coalesce(1).write.mode("append").parquet(src)
    assert sorted(tuple(map(str, r)) for r in run().collect()) == plain(rows)  # only new files were read
    assert sorted(tuple(map(str, r)) for r in run().collect()) == plain(rows)


def test_evaluation_marks_the_best_step(spark):
    p = TASKS["intent"].prepare(spark, SF_SMALL, {"inputs": 32}, all_columns=True).select("id", "input_ids", "attention_mask", "labels")
    models = {s: (lambda s=s: BagModel(7, s)) for s in (1, 2, 3)}
    h = {r["step"]: r for r in evaluate(TASKS["intent"], p, models, ["input_ids", "attention_mask"], ["id"], batch_size=8).collect()}
    best = -1.0
    for s, load in models.items():
        rows = p.collect()
        ids, mask = np.array([r["input_ids"] for r in rows]), np.array([r["attention_mask"] for r in rows])
        right = load().forward(ids, mask)[0].argmax(axis=1) == np.array([r["labels"] for r in rows])
        assert h[s]["score"] == pytest.approx(100 * right.mean()) and h[s]["count"] == len(rows) and h[s]["metric"] == "accuracy"
        assert h[s]["is_best"] == (h[s]["score"] > best) and h[s]["line"] == f"eval/accuracy: {h[s]['score']:.3f}"
        best = max(best, h[s]["score"])
