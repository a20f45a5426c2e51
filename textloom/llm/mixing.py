"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Each document of a source has the same expected number of copies, ``target / source size``. The documents of a
source stand in one order; the prefix sum of their expected copies, shifted by one random offset per source, gives
a document one copy for each integer boundary that its step crosses. The order goes by size class first, so the
words taken follow the target closely, and by a hash of the id within a class.

The prefix sum never needs a source in one task: it is the document's place within (source, size class, hash
part), plus the counts of the classes and parts before, which come from one pre-aggregated count table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import documents, materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A join key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(source_sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources by code point, null last, weigh ``weights``, repeating. A target stops at ``max_copies`` times its
    source's size and the excess goes to the others by weight: sorted by cap per weight, the first source whose
    share of what is left stays within its cap ends the capped ones. One row per source, so the two windows
    over all sources see a short list. All sums are integers; each target is one division.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights)) + 1)
    s = source_sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_copies)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("place", F.row_number().over(by_cap))
         .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    fits = F.col("w") * F.col("left") <= F.col("cap") * F.col("left_w")
    first = F.min(F.when(fits, F.struct("place", "left", "left_w"))).over(everything)
    s = s.withColumn("first", first)
    share = (F.col("w") * F.col("first.left")).cast("double") / F.col("first.left_w").cast("double")
    target = F.when(F.col("place") < F.col("first.place"), F.col("cap").cast("double")).otherwise(share)
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix",
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", spread: int = 1) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies``: how often each row is emitted.

    ``mix_size`` counts the words ``[^\\x20\\x09-\\x0D]+`` of the text (null: 0). Copies of a row differ by at most
    one from ``target / source size`` and never pass ``max_copies``. The result depends on ids, sizes, sources and
    ``seed`` alone, so reruns agree. ``spread`` hex digits of the id's hash split each (source, size class) so
    that no source and no class has to fit one task. Null sources are a source of their own; rows without words
    get copies at the rate of their source; a source without any words gets none; a null id is an id like others;
    rows that repeat are separate rows. Further columns pass through, but for those with one of the four names,
    which are replaced; the result of an empty table is empty.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    size = n_words(F.col(text_col))
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    digits = F.col("mix_size").cast("string")
    keyed = (docs.withColumn("mix_size", size).withColumn("__mark", mark)
             .withColumn("__class", F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 2)))
             .withColumn("__part", F.substring("__mark", 1, spread))
             .withColumn("__key", _key(F.col(source_col))))
    bucket = ["__key", "__class", "__part"]
    counts = materialise(keyed.groupBy(F.col(source_col).alias("source"), *bucket)
                         .agg(F.count("*").alias("n"), F.sum("mix_size").alias("words")), "mix-counts")
    goal = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies)
    # documents before a bucket: whole classes before it, then the parts before it within its class
    per_class = counts.groupBy("__key", "__class").agg(F.sum("n").alias("class_n"))
    so_far = Window.partitionBy("__key").orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)
    per_class = per_class.withColumn("class_before", F.coalesce(F.sum("class_n").over(so_far), F.lit(0)))
    parts = Window.partitionBy("__key", "__class").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("part_before", F.coalesce(F.sum("n").over(parts), F.lit(0)))
               .join(per_class.select("__key", "__class", "class_before"), ["__key", "__class"])
               .join(goal.withColumn("__key", _key(F.col("source"))).drop("source"), "__key")
               .select(*bucket, (F.col("class_before") + F.col("part_before")).alias("__before"),
                       F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")))
    place = Window.partitionBy(*bucket).orderBy("__mark", F.col(id_col).asc_nulls_first(), "mix_size")
    rows = keyed.withColumn("__place", F.row_number().over(place)).join(offsets, bucket)
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size").cast("double")).otherwise(0.0)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:offset:"), F.col("__key")).cast("binary")), 1, 8), 16, 10)
    start = start.cast("double") / F.lit(4294967296.0)
    upto = (F.col("__before") + F.col("__place")).cast("double")
    copies = F.floor(upto * rate + start) - F.floor((upto - 1) * rate + start)
    return rows.withColumn("mix_copies", F.least(copies, F.lit(max_copies)).cast("long")).select(
        *docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies")


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row of ``mix()`` as often as ``mix_copies`` says."""
    return (mixed.filter("mix_copies > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*columns))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the whole ``documents`` table: per document its size, its source's size and target, words taken."""
    return mix(documents(spark, sf_dir)).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS mark
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY k
              ORDER BY lpad(length(size::VARCHAR)::VARCHAR, 2, '0') || left(size::VARCHAR, 2), mark, doc_id NULLS FIRST, size) AS place
  FROM sized),
src AS (
  SELECT k, source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w
  FROM sized GROUP BY k, source),
ranked AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER o AS rnk,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w
  FROM src WINDOW o AS (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST)),
stop AS (SELECT * FROM ranked WHERE w * rest <= cap * rest_w ORDER BY rnk LIMIT 1),
goal AS (
  SELECT r.k, r.source_size,
         CASE WHEN r.rnk < s.rnk THEN r.cap::DOUBLE ELSE (r.w * s.rest)::DOUBLE / s.rest_w::DOUBLE END AS target
  FROM ranked r, stop s),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
         ('0x' || left(md5('mix:offset:' || k), 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM goal)
SELECT p.doc_id, p.size, g.source_size, g.target,
       p.size * least(floor(p.place::DOUBLE * g.rate + g.start)
                      - floor((p.place - 1)::DOUBLE * g.rate + g.start), 3)::BIGINT AS taken
FROM placed p JOIN rates g USING (k)
"""
