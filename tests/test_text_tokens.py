"""Hand-made rows for text and token functions (Unicode edge cases the driver tables lack)."""

import re

from pyspark.sql import functions as F

from textloom.functions import post as P
from textloom.functions import text as X
from textloom.functions import tokens as K


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_collapse_space_unicode(spark):
    texts = ["a  b", "x　y", "p\x85q", "tab\t\nnl", "  lead", " z"]
    got = _one(spark, [(t,) for t in texts], "t string", X.collapse_space("t"))
    assert got == [re.sub(r"\s+", " ", t) for t in texts]


def test_pad_punctuation_matches_python(spark):
    texts = ["안녕, 세계!", "½ cup (café)", "éclair", "emoji 😀 ok", "snake_case-word"]
    got = _one(spark, [(t,) for t in texts], "t string", X.pad_punctuation("t"))
    want = [re.sub(r"\s+", " ", re.sub(r"([^_\s\w])", r" \1 ", t)) for t in texts]
    assert got == want


def test_mark_entity_literal_and_edges(spark):
    rows = [("a+b (c) d", "a+b", 0), ("x a+b", "a+b", 2), ("abc", "zz", 0), ("end word", "word", 4)]
    got = _one(spark, rows, "t string, w string, s int", X.mark_entity("t", F.col("w"), F.col("s"), "*"))
    assert got == ["*a+b* (c) d", "x *a+b*", "abc", "end *word*"]


def test_one_decimal_contract(spark):
    got = _one(spark, [(0.7,), (1.0,), (12.3,)], "x double", X.one_decimal("x"))
    assert got == ["0.7", "1.0", "12.3"]


def test_hash_tokens_offsets(spark):
    texts = ["", "  two  spaces ", "a\nb\tc", "one"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        K.HashVocab().tokens("t").alias("tk")).collect()
    for t, r in zip(texts, rows):
        toks = [(m.group(0), m.start(), m.end()) for m in re.finditer(r"[^ \t\n\r]+", t)]
        assert [(x["tok"], x["start"], x["end"]) for x in r["tk"]] == toks
        assert all(3 <= x["id"] < 32003 for x in r["tk"])


def test_eos_and_padding(spark):
    df = spark.createDataFrame([([],), ([5, 6],), ([5, 1],), ([4, 5, 6, 7, 8],)], "a array<int>")
    out = df.select(K.append_eos("a").alias("e"), K.trim_append_eos("a", 3).alias("t5"),
                    K.trim_pad("a", 4).alias("p"), K.attention_mask("a", 4).alias("m")).collect()
    assert [r["e"] for r in out] == [[1], [5, 6, 1], [5, 1], [4, 5, 6, 7, 8, 1]]
    assert [r["t5"] for r in out] == [[1], [5, 6, 1], [5, 1, 1], [4, 5, 1]]
    assert [r["p"] for r in out] == [[0, 0, 0, 0], [5, 6, 0, 0], [5, 1, 0, 0], [4, 5, 6, 7]]
    assert [sum(r["m"]) for r in out] == [0, 2, 2, 4]


def test_post_processing(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9], [4, 1, 5], "3.5"), ([2.0], [4, 5], "x1"), ([], [1], " 7 ")],
                               "l array<double>, ids array<int>, s string")
    out = df.select(P.argmax("l").alias("a"), P.cut_at_eos("ids").alias("c"), P.decode_float("s").alias("f"),
                    P.decode_label(F.lit("neutral"), ["entailment", "neutral"]).alias("k")).collect()
    assert [r["a"] for r in out] == [1, 0, None]
    assert [r["c"] for r in out] == [[4], [4, 5], []]
    assert [r["f"] for r in out] == [3.5, -1.0, 7.0]
    assert out[0]["k"] == 1


def test_decode_encode_identity(spark):
    v = K.TableVocab(size=10)
    corpus = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "")], "k int, text string")
    vocab = v.build(corpus, "text")
    ids = v.encode(corpus, ["k"], "text", vocab)
    out = P.decode_columns(ids, ["ids"], v.word_list(vocab)).orderBy("k").collect()
    assert [r["ids"] for r in out] == ["the cat sat on the mat", ""]
