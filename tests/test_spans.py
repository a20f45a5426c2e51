"""Span, tag and window operators on hand-made rows, against small pure-Python references."""

import math

from pyspark.sql import functions as F

from textloom.functions.tokens import HashVocab
from textloom.labels import CHAR_NER_IOB2
from textloom.operators import spans as N


def _spans_py(chars, tags, compat=False):
    """Reference semantics (fixed form): B opens, I extends, other closes; orphan I ignored."""
    out, cur = [], None
    for i, t in enumerate(tags):
        if t.startswith("B"):
            if cur:
                out.append(cur)
            cur = [i, i + 1, t.split("-")[-1]]
        elif t.startswith("I") and cur:
            cur[1] = i + 1
        else:
            if cur:
                out.append(cur)
            cur = None
    if cur and not compat:
        out.append(cur)
    return [("".join(chars[b:e]), b, e, lab) for b, e, lab in out]


def test_char_tags_to_spans_edges(spark):
    cases = [
        (list("abcde"), ["B-PS", "I-PS", "O", "B-LC", "I-LC"]),       # span open at end
        (list("abcd"), ["I-PS", "I-PS", "B-QT", "O"]),                # orphan I at start
        (list("abc"), ["B-PS", "B-PS", "I-QT"]),                      # B closes B
        (list("xy"), ["O", "O"]),
    ]
    df = spark.createDataFrame(cases, "c array<string>, t array<string>")
    for compat in (False, True):
        got = df.select(N.char_tags_to_spans("c", "t", compat=compat).alias("s")).collect()
        for (c, t), r in zip(cases, got):
            assert [(s["form"], s["begin"], s["end"], s["label"]) for s in r["s"]] == _spans_py(c, t, compat)


def test_spans_char_tags_round_trip(spark):
    text = "Seoul is big, yes"
    spans = [("Seoul", 0, 5, "LC"), ("big", 9, 12, "QT")]
    df = spark.createDataFrame([(text, spans)], "text string, NE array<struct<form:string,begin:int,end:int,label:string>>")
    tags = df.select(N.spans_to_char_tags("NE", F.length("text"), CHAR_NER_IOB2).alias("t")).collect()[0]["t"]
    names = [CHAR_NER_IOB2[i] for i in tags]
    back = _spans_py(list(text), names)
    assert [(b, e, lab) for _, b, e, lab in back] == [(0, 5, "LC"), (9, 12, "QT")]


def test_token_tags_start_end_and_shared_token(spark):
    text = "ab cd-ef gh"
    spans = [("ab", 0, 2, "PS"), ("cd", 3, 5, "LC"), ("ef", 6, 8, "QT"), ("h", 10, 11, "DT")]
    df = spark.createDataFrame([(text, spans)], "text string, NE array<struct<form:string,begin:int,end:int,label:string>>")
    df = df.withColumn("tk", HashVocab().tokens("text"))
    got = df.select(N.spans_to_token_tags("tk", "NE", CHAR_NER_IOB2).alias("t")).collect()[0]["t"]
    names = [CHAR_NER_IOB2[i] for i in got]
    # token "cd-ef" is touched by two spans: the later one wins; span at char 0 and span ending at text end
    assert names == ["B-PS", "B-QT", "B-DT"]


def test_entity_without_tokens_is_null(spark):
    df = spark.createDataFrame([("a  b", {"word": " ", "start_idx": 1, "end_idx": 1, "type": "X"})],
                               "t string, e struct<word:string,start_idx:int,end_idx:int,type:string>")
    df = df.withColumn("tk", HashVocab().tokens("t"))
    r = df.select(N.entity_token_bounds("tk", F.length("t"), [F.col("e")]).alias("b")).collect()[0]["b"]
    assert r == [None]


def _windows_py(n, L, S):
    out, start = [], 0
    while start < n:
        length = min(n - start, L)
        out.append((start, length))
        if start + length == n:
            break
        start += min(length, S)
    return out


def test_doc_windows_closed_form(spark):
    rows = []
    for n in range(0, 40):
        rows.append((n, " ".join(f"w{i}" for i in range(n))))
    df = spark.createDataFrame(rows, "id long, text string")
    for L, S in [(5, 2), (4, 4), (3, 7), (10, 3)]:
        w = N.doc_windows(df, "id", "text", span_length=L, doc_stride=S)
        got = w.groupBy(F.substring_index("id", ":", 1).cast("long").alias("doc")).count().collect()
        counts = {r["doc"]: r["count"] for r in got}
        for n in range(40):
            assert counts.get(n, 0) == len(_windows_py(n, L, S)), (n, L, S)


def test_windows_cover_every_token(spark):
    df = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(23)))], "id long, text string")
    w = N.doc_windows(df, "id", "text", span_length=6, doc_stride=4)
    seen = set()
    for r in w.collect():
        seen.update(r["text"].split())
    assert seen == {f"t{i}" for i in range(23)}


def test_mention_mark_fixed_vs_compat(spark):
    text = "aa bb aa"
    cands = [{"begin": 0, "end": 2, "form": "aa"}, {"begin": 6, "end": 8, "form": "aa"},
             {"begin": 2, "end": 2, "form": ""}]
    df = spark.createDataFrame([(text, {"begin": 0, "end": 2, "form": "aa"}, cands)],
                               "t string, tg struct<begin:int,end:int,form:string>, c array<struct<begin:int,end:int,form:string>>")
    for compat, want in [(False, [(0, 4), (8, 10), (4, 4)]), (True, [(0, 4), (8, 10), (2, 4)])]:
        marked, moved = N.mark_mention(F.col("t"), F.col("tg"), F.col("c"), compat=compat)
        r = df.select(marked.alias("m"), moved.alias("c")).collect()[0]
        assert r["m"] == "*aa* bb aa"
        assert [(c["begin"], c["end"]) for c in r["c"]] == want


def test_mention_augment_ids_unique(spark):
    cr = {"mention": [{"begin": [0, 6], "end": [2, 8], "form": ["aa", "aa"]},
                      {"begin": [3], "end": [5], "form": ["bb"]}]}
    df = spark.createDataFrame([("d1", "aa bb aa", cr)],
                               "id string, text string, CR struct<mention:array<struct<begin:array<int>,end:array<int>,form:array<string>>>>")
    out = N.mention_augment(df, "id", "text").collect()
    ids = [r["id"] for r in out]
    assert len(ids) == len(set(ids)) == 3
    first = [r for r in out if r["id"] == "d1:0:0"][0]
    assert first["text_pretokenized"] == "*aa* bb aa"
    assert first["targets"] == [1, 0, 1]
    assert math.isclose(len(first["text"]), 3)


def test_nested_and_crossing_spans_are_painted_in_list_order(spark):
    """Later spans of the list overwrite earlier ones, whatever their begin."""
    text = "aa bb cc dd"
    tags = ["O", "B-A", "I-A", "B-B", "I-B"]
    rows = [(1, text, [(0, 11, "A"), (4, 6, "B")]), (2, text, [(0, 8, "A"), (4, 11, "B")]), (3, text, [(4, 6, "B"), (0, 11, "A")]), (4, text, []),
            (5, text, [(7, 7, "A"), (0, 2, "O")])]
    df = spark.createDataFrame(rows, "id int, text string, NE array<struct<begin:int,end:int,label:string>>").withColumn("tk", HashVocab().tokens("text"))
    got = {r["id"]: list(r["t"]) for r in df.select("id", N.spans_to_token_tags("tk", "NE", tags).alias("t")).collect()}
    assert got == {1: [1, 3, 2, 2], 2: [1, 3, 4, 4], 3: [1, 2, 2, 2], 4: [0] * 4, 5: [0] * 4}
    chars = {r["id"]: list(r["t"]) for r in df.select("id", N.spans_to_char_tags("NE", F.length("text"), tags).alias("t")).collect()}
    assert chars[1] == [1, 2, 2, 2, 3, 4, 2, 2, 2, 2, 2] and chars[2] == [1, 2, 2, 2, 3, 4, 4, 4, 4, 4, 4] and chars[4] == [0] * 11


def test_steps_are_small_and_whole():
    """A batch is worked on in slices of bounded size, in order, with the same result as at once."""
    import random

    import pyarrow as pa

    from textloom.functions.batches import STEP, groups, steps, stepwise

    rng = random.Random(8)
    tags = [[rng.choice(["O", "B-PS", "I-PS"]) for _ in range(rng.choice([0, 3, 400]))] if i % 9 else None for i in range(3000)]
    chars = pa.array([None if t is None else [rng.choice("abc ") for _ in t] for t in tags], pa.list_(pa.string()))
    tags = pa.array(tags, pa.list_(pa.string()))
    parts = list(steps((chars, tags)))
    assert len(parts) > 20 and all(len(c) == 1 or c.nbytes + t.nbytes <= STEP for c, t in parts)
    assert pa.concat_arrays([c for c, _ in parts]).equals(chars)
    for compat in (False, True):
        assert stepwise(lambda c, t: N.spans_of_tags(c, t, compat), chars, tags).to_pylist() == N.spans_of_tags(chars, tags, compat).to_pylist()
    texts = ["x" * rng.randrange(2 * STEP // 10) for _ in range(100)]
    cut = list(groups(texts))
    assert sum(cut, []) == texts and all(sum(map(len, g[:-1])) < STEP for g in cut)


def test_mentions_leave_the_task_in_steps(spark):
    """What the mentions of a batch fan out to is not built at once."""
    from textloom.operators import spans

    seen = spark.sparkContext.accumulator(0)

    class Tok(HashVocab):
        def batch(self, texts):
            assert sum(map(len, texts[:-1])) < 1 << 18
            seen.add(1)
            return super().batch(texts)

    text = "ab cd " * 200
    chains = [{"mention": [{"begin": [0, 6, 12], "end": [2, 8, 14], "form": ["ab"] * 3}]}]
    df = spark.createDataFrame([(i, text, chains[0]) for i in range(600)],
                               "id long, text string, CR struct<mention:array<struct<begin:array<int>,end:array<int>,form:array<string>>>>").coalesce(1)
    assert spans.mention_augment(df, "id", "text", tokenizer=Tok()).count() == 1800
    assert spans.mention_tags(df, "text", tokenizer=Tok()).count() == 600
    assert seen.value > 8
