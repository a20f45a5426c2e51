"""Derived inputs that connect the driver tables to the task shapes.

Each function reads the given tables (so its work grows with them) and builds
the input shape one family of operators needs.  The DuckDB oracle builds the
same tables with the same formulas (``textloom.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.hof import bind_column, let, shift_right
from textloom.functions.tokens import HashVocab
from textloom.labels import CHAR_NER_IOB2, CHAR_NER_TYPES
from textloom.operators.ranking import group_index
from textloom.session import read_table, text_table

# ---- fixed values of the fixtures ----
VOWELS = "aeiouAEIOU"
HISTORY_ORIGIN = "2024-01-01"
# ---- end of fixed values ----


def space_words(text) -> Column:
    """Words split on one space, with 0-based offsets: ``ARRAY<STRUCT<w, off>>`` (empty words kept)."""
    t = F.col(text) if isinstance(text, str) else text
    pieces = F.split(t, " ", -1)
    spaces = F.array_compact(F.transform(F.split(t, "", -1), lambda ch, i: F.when(ch == " ", i)))
    starts = F.concat(F.array(F.lit(0)), F.transform(spaces, lambda p: p + 1))
    return F.transform(F.arrays_zip(pieces.alias("w"), starts.alias("off")),
                       lambda z: F.struct(z["w"].alias("w"), z["off"].alias("off")))


def cls(spark: SparkSession, sf: str) -> DataFrame:
    """documents ⟕ labels: id, text, lang, source, label (−1 = none), pred = n_chars % 2.

    ``labels`` covers a fraction of the documents and grows with them, so the
    join is left to the planner (AQE turns it into a broadcast when the
    measured side is small, a sort-merge join otherwise).
    """
    return with_labels(text_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def with_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``cls`` over given tables (``documents`` may be a stream)."""
    return documents.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        F.col("doc_id").alias("id"), "text", "lang", "source",
        F.coalesce(F.col("quality"), F.lit(-1)).cast("int").alias("label"),
        (F.col("n_chars") % 2).alias("pred"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turn t and assistant turn t+1 of one conversation.

    Joined on the pair ``(conv_id, turn)`` so even a conversation holding a
    third of all turns is spread over tasks by turn.
    """
    c = text_table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("utext"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("atext"))
    j = u.join(a, ["conv_id", "turn"])
    return j.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn",
        F.col("utext").alias("target"), F.col("atext").alias("prediction"),
        F.col("utext").alias("question"), F.col("atext").alias("context"),
        F.element_at(F.split("atext", " ", -1), 1).alias("answer"),
        ((F.col("turn") % 4) == 0).alias("is_impossible"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """events with a similarity-style ``labels`` struct."""
    e = read_table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"), "value", "event_type", "props",
        F.struct(
            (F.round("value") / 10).alias("label"),
            (F.col("value") / 10).alias("real-label"),
            (F.col("value") >= 50).cast("int").alias("binary-label"),
        ).alias("labels"))


def _word_entity(ws: Column, k: int, etype: str) -> Column:
    w = F.get(ws, k - 1).getField("w")
    off = F.get(ws, k - 1).getField("off")
    return F.struct(w.alias("word"), off.cast("int").alias("start_idx"),
                    (off + F.length(w) - 1).cast("int").alias("end_idx"), F.lit(etype).alias("type"))


def ents(spark: SparkSession, sf: str, swap: bool = False) -> DataFrame:
    """Relation rows: subject = word 2, object = word 4 (``swap`` exchanges them); label = turn % 30."""
    c = text_table(spark, sf, "conversations").withColumn("_ws", space_words("text"))
    s, o = _word_entity(F.col("_ws"), 2, "PER"), _word_entity(F.col("_ws"), 4, "ORG")
    if swap:
        s, o = o, s
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn", F.col("text").alias("sentence"),
        s.alias("subject_entity"), o.alias("object_entity"),
        (F.col("turn") % 30).cast("int").alias("label"))


def _char_class(ch: Column) -> Column:
    return F.when(ch.isin(*VOWELS), F.lit("QT")).when(ch.isin(",", "."), F.lit("LC")).otherwise(F.lit("O"))


def chartags(spark: SparkSession, sf: str) -> DataFrame:
    """One character list per conversation turn with IOB2 ids (vowel → QT, comma/period → LC)."""
    c = text_table(spark, sf, "conversations")
    b_qt, b_lc, o = CHAR_NER_IOB2.index("B-QT"), CHAR_NER_IOB2.index("B-LC"), CHAR_NER_IOB2.index("O")

    def tag(z):
        # B-x when the previous char has another class, else I-x (= B-x + 1 in the IOB2 list)
        k, prev = z["k"], z["prev"]
        inside = F.when(prev == k, F.lit(1)).otherwise(F.lit(0))
        return F.when(k == "QT", inside + b_qt).when(k == "LC", inside + b_lc).otherwise(F.lit(o)).cast("int")

    chars = F.split("text", "", -1)
    # class of each char aligned with the class of the previous char (no random access in lambdas)
    classes = let(F.transform(chars, _char_class),
                  lambda k: F.transform(F.arrays_zip(k.alias("k"), shift_right(k, "#").alias("prev")), tag))
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn", chars.alias("tokens"), classes.alias("ner_tags"))


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every space-split word of ≥ 6 chars is a span (end exclusive), label = length % 6.

    Two encodings: ``NE`` array of structs with label names (character-NER
    types) and ``ne`` parallel arrays with label ids.
    """
    c = text_table(spark, sf, "conversations").withColumn("_ws", space_words("text"))
    sp = F.filter("_ws", lambda s: F.length(s.getField("w")) >= 6)
    types = F.array(*[F.lit(t) for t in CHAR_NER_TYPES])
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn", "text",
        F.transform(sp, lambda s: F.struct(
            s.getField("w").alias("form"), s.getField("off").cast("int").alias("begin"),
            (s.getField("off") + F.length(s.getField("w"))).cast("int").alias("end"),
            F.get(types, F.length(s.getField("w")) % 6).alias("label"))).alias("NE"),
        F.struct(
            F.transform(sp, lambda s: s.getField("off").cast("int")).alias("begin"),
            F.transform(sp, lambda s: (s.getField("off") + F.length(s.getField("w"))).cast("int")).alias("end"),
            F.transform(sp, lambda s: (F.length(s.getField("w")) % 6).cast("int")).alias("label"),
        ).alias("ne_par"))


def wide_spans(spark: SparkSession, sf: str) -> DataFrame:
    """``spans`` with label ids of the wide type set: (7 · length + begin) % 150."""
    s = spans(spark, sf)
    label = F.transform(F.arrays_zip(F.col("ne_par.begin").alias("b"), F.col("ne_par.end").alias("e")),
                        lambda x: ((x["e"] - x["b"]) * 7 + x["b"]) % 150)
    return s.withColumn("ne_par", F.struct(F.col("ne_par.begin").alias("begin"), F.col("ne_par.end").alias("end"), label.alias("label")))


def nested_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans that nest and cross: pairs of words, then some single words, then triples, in that list order.

    Word k (from 0) starts a pair if k % 3 = 0, is a single if k % 4 = 1 and starts a triple if k % 5 = 2; the
    label is type k % 6.  A pair or triple ends with the last word of the text at the latest.
    """
    c = bind_column(text_table(spark, sf, "conversations"), "_ws", space_words("text"))
    types = F.array(*[F.lit(t) for t in CHAR_NER_TYPES])
    n = F.size("_ws")

    def stretch(words: int, every: int, at: int):
        last = lambda k: F.get(F.col("_ws"), F.least(k + words, n) - 1)
        all_ = F.transform("_ws", lambda s, k: F.struct(
            s["off"].cast("int").alias("begin"), (last(k)["off"] + F.length(last(k)["w"])).cast("int").alias("end"),
            F.get(types, k % 6).alias("label")))
        return F.filter(all_, lambda s, k: (k % every == at) & (s["end"] > s["begin"]))

    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "text", F.concat(stretch(2, 3, 0), stretch(1, 4, 1), stretch(3, 5, 2)).alias("NE"))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Coreference-style chains: words of ≥ 4 chars seen at least twice in one turn; turns without a chain stay.

    Words are grouped per (turn, word) — a shuffle whose groups are bounded by
    one text — then chains are regrouped per turn, ordered by first position.
    """
    c = text_table(spark, sf, "conversations")
    w = c.select("conv_id", "turn", F.explode(space_words("text")).alias("s")) \
        .select("conv_id", "turn", F.col("s.w").alias("w"), F.col("s.off").cast("int").alias("off")) \
        .where(F.length("w") >= 4)
    ch = w.groupBy("conv_id", "turn", "w").agg(F.array_sort(F.collect_list("off")).alias("offs")) \
        .where(F.size("offs") >= 2)
    ch = ch.select("conv_id", "turn", F.struct(
        F.get(F.col("offs"), 0).alias("first"),
        F.col("offs").alias("begin"),
        F.transform("offs", lambda o: o + F.length("w")).alias("end"),
        F.transform("offs", lambda o: F.col("w")).alias("form")).alias("chain"))
    per_row = ch.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("chain")).alias("chains"))
    cr = F.struct(F.transform("chains", lambda x: F.struct(x.getField("begin").alias("begin"),
                                                            x.getField("end").alias("end"),
                                                            x.getField("form").alias("form"))).alias("mention"))
    none = F.array().cast(per_row.schema["chains"].dataType)
    per_row = c.select("conv_id", "turn", "text").join(per_row, ["conv_id", "turn"], "left") \
        .withColumn("chains", F.coalesce("chains", none))
    return per_row.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn", "text", cr.alias("CR"))


def logits(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("logits"),
                    F.col("label").alias("labels"))


def tagseq(spark: SparkSession, sf: str) -> DataFrame:
    """Word-level IOB2 ids (character-NER tag set) as targets plus a perturbed prediction.

    prediction = (tag + 1) % 13 where (conv_id·31 + turn·7 + pos) % 5 = 0;
    ``ragged`` drops the prediction's last word.  Also the char-level view:
    ``c2t`` (word index per char) and ``char_tags`` (true tags per char).
    """
    from textloom.operators.spans import spans_to_char_tags

    sp = spans(spark, sf)
    outside = CHAR_NER_IOB2.index("O")
    ws = space_words("text")
    tag = F.transform(ws, lambda s: F.when(F.length(s.getField("w")) >= 6,
                                           (F.length(s.getField("w")) % 6) * 2).otherwise(F.lit(outside)).cast("int"))
    base = sp.withColumn("labels", tag)
    pred = F.transform("labels", lambda t, i: F.when(
        (F.col("conv_id") * 31 + F.col("turn") * 7 + i) % 5 == 0, (t + 1) % 13).otherwise(t).cast("int"))
    c2t = F.flatten(F.transform(ws, lambda s, i: F.concat(
        F.array_repeat(i, F.length(s.getField("w"))),
        F.array_repeat(F.lit(None).cast("int"), F.lit(1)))))
    return base.withColumns({
        "predictions": pred,
        "c2t": F.slice(c2t, 1, F.length("text")),
        "char_tags": spans_to_char_tags(F.col("NE"), F.length("text"), CHAR_NER_IOB2),
    }).withColumn("ragged", F.slice("predictions", 1, F.size("predictions") - 1)) \
        .select("id", "conv_id", "turn", "text", "labels", "predictions", "ragged", "c2t", "char_tags")


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Per-day evaluation history from events: step = day index, score = % of values below 50."""
    e = read_table(spark, sf, "events")
    step = F.datediff(F.to_date("ts"), F.lit(HISTORY_ORIGIN).cast("date")).cast("bigint")
    return e.groupBy(step.alias("step")).agg(
        F.round(F.avg((F.col("value") < 50).cast("double")) * 100, 3).alias("score"),
        F.count(F.lit(1)).cast("bigint").alias("count"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of vectors: seq = label, pos = rank of vec_id in the label, mask = pos % 4 ≠ 3."""
    e = read_table(spark, sf, "embeddings")
    idx = group_index(e, ["label"], ["vec_id"], "pos")
    return idx.select(F.col("label").alias("seq"), F.col("pos").cast("int").alias("pos"),
                      F.col("embedding").alias("vec"), ((F.col("pos") % 4) != 3).cast("int").alias("mask"),
                      "vec_id")


def eos_ids(spark: SparkSession, sf: str, vocab: HashVocab | None = None) -> DataFrame:
    """Hash-vocabulary ids of each turn with EOS (1) put after word ``turn + 3``."""
    v = vocab or HashVocab()
    c = text_table(spark, sf, "conversations")
    ids = v.ids(F.col("text"))
    k = (F.col("turn") + 3).cast("int")
    with_eos = F.when(F.size("_ids") >= k, F.concat(F.slice("_ids", 1, k), F.array(F.lit(1)),
                                                    F.slice("_ids", k + 1, F.greatest(F.size("_ids") - k, F.lit(0))))) \
        .otherwise(F.col("_ids"))
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn", "text", ids.alias("_ids")).withColumn("ids", with_eos).drop("_ids")
