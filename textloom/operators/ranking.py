"""Positional indexes and ranks without a one-partition window.

Spark has no distributed ``row_number() over (order by …)``: without a
partition key the window pulls every row into one task.  These helpers give
the same numbers in three steps:

1. bounds of the order key are a scalar subquery: keys whose hash falls below
   a share are sorted and every k-th is a bound.  The share follows the row
   count, so there is one bucket per ``_ROWS`` rows however large the table.
   Bounds are a pure function of the data: every branch of the plan, every
   retry and every column selection sees the same buckets (a hot group is
   split because the order key is part of the bounds), and a row finds its
   bucket by binary search.  Nothing runs while the plan is built;
2. rows per bucket (and group) are counted and turned into offsets: at most
   ``#buckets + #groups`` rows;
3. rows are numbered by a window inside their bucket and the offset is added.

The sample decides only how evenly the buckets are filled, never a result.
The order columns must form a total order (ties would make the numbering
depend on shuffle arrival order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows per bucket, and sampled keys per bucket.
_ROWS, _PER_BUCKET = 1 << 20, 24
#: Range of the hash that decides which keys are sampled.
_HASH = 1 << 40
#: Steps of the binary search: more buckets than this power of two never arise.
_DEPTH = 24


def _parallelism(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _key(columns: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])


def _buckets(df: DataFrame, n: int | None) -> tuple[Column, Column]:
    """``(number of rows, number of buckets)`` as scalar subqueries."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return total, F.greatest(F.lit(_parallelism(df, n)).cast("long"), F.ceil(total / _ROWS))


def _bounds(keys: DataFrame, n: int | None) -> Column:
    """``STRUCT<bounds, steps>`` of the sorted bounds of column ``k`` and the binary search's step widths."""
    total, buckets = _buckets(keys, n)
    share = buckets * _PER_BUCKET * _HASH / F.greatest(total, F.lit(1))
    sample = keys.where(F.pmod(F.xxhash64("k"), F.lit(_HASH)) < share)
    s = sample.agg(F.array_sort(F.collect_list("k")).alias("s"), buckets.alias("n"))
    picked = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(1).cast("long"), F.col("n") - 1),
                                                lambda i: F.get("s", F.floor(i * F.size("s") / F.col("n")).cast("int"))))
    s = s.where(F.size("s") > 0).select(picked.alias("b"))
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(_DEPTH - 1, -1, -1)]), lambda w: w <= F.size("b"))
    return s.select(F.struct(F.col("b").alias("bounds"), steps.alias("steps")).alias("x")).scalar()


def _bucket_of(key: Column, found: Column) -> Column:
    """How many bounds lie at or below ``key``, by binary search (0 without bounds)."""
    at = F.aggregate(found["steps"], F.lit(0), lambda lo, w: lo + F.when(F.get(found["bounds"], lo + w - 1) <= key, w).otherwise(0))
    return F.coalesce(at, F.lit(0))


def _bucketed(df: DataFrame, order: list[str], n: int | None, bucket=None) -> DataFrame:
    """``df`` with the bucket ``_b`` of each row; ``bucket`` maps the number of buckets to a bucket that does not fall
    along ``order``, where one is known without a sample (hashed keys)."""
    if bucket is not None:
        return df.withColumn("_b", bucket(_buckets(df, n)[1]))
    key = _key(order)
    r = df.withColumn("_x", _bounds(df.select(key.alias("k")), n))
    return r.withColumn("_b", _bucket_of(key, F.col("_x"))).drop("_x")


def _offsets(r: DataFrame) -> DataFrame:
    """``(_b, _n, _off)``: rows of a bucket and before it.  One row per ``_ROWS`` rows: one window and a broadcast are safe."""
    counts = r.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_b", "_n", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))


def global_index(df: DataFrame, order: list, idx_col: str = "idx", partitions: int | None = None, bucket=None) -> DataFrame:
    """Exact 0-based position of each row in ``order`` (a total order).  ``bucket``: see ``_bucketed``."""
    r = _bucketed(df, order, partitions, bucket)
    local = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    out = r.withColumn("_local", local).join(F.broadcast(_offsets(r).drop("_n")), "_b")
    return out.withColumn(idx_col, (F.col("_off") + F.col("_local")).cast("bigint")).drop("_b", "_local", "_off")


def key_at(df: DataFrame, order: list, position: Column, partitions: int | None = None) -> Column:
    """The order key (a struct) at a 0-based position, as a scalar subquery; NULL beyond the last row.

    Only the bucket that holds the position is sorted; the other rows are counted.
    """
    r = _bucketed(df.select(*order), order, partitions)
    at = _offsets(r).where((F.col("_off") <= position) & (position < F.col("_off") + F.col("_n"))) \
        .select("_b", (position - F.col("_off") + 1).alias("_k"))
    hit = r.join(F.broadcast(at), "_b").withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return hit.where(F.col("_rn") == F.col("_k")).agg(F.first(_key(order)).alias("k")).scalar()


def group_index(df: DataFrame, group: list[str], order: list, idx_col: str = "idx",
                partitions: int | None = None) -> DataFrame:
    """Exact 0-based position of each row inside its group, ordered by ``order``.

    A hot group spans several buckets; its rows are numbered across them, so
    no task ever holds a whole group.  A NULL group is a group of its own.
    """
    r = _bucketed(df, [*group, *order], partitions)
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summary = r.groupBy("_b", *group).agg(F.count(F.lit(1)).alias("_n"))
    summary = summary.select("_b", _key(group).alias("_g"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_b", *group).orderBy(*order)) - 1
    rows = r.withColumn("_local", local).withColumn("_g", _key(group))
    out = rows.join(summary, ["_b", "_g"])  # a struct of NULLs equals itself
    return out.withColumn(idx_col, (F.col("_off") + F.col("_local")).cast("bigint")).drop("_b", "_g", "_local", "_off")


def average_rank(df: DataFrame, value_col: str, rank_col: str = "rank", partitions: int | None = None,
                 group: list[str] = ()) -> DataFrame:
    """Distinct values of ``value_col`` (per ``group``) with their average (tie-aware, 1-based) rank.

    rank(v) = rows_below(v) + (ties(v) + 1) / 2, counted inside the group.
    Works on the distinct-value table (partial aggregation first, so a hot
    value costs one row), bucketed on ``(group, value)`` with a weighted
    running sum per bucket and per-bucket offsets per group, so a group that
    holds most rows still spreads over many tasks.
    """
    g = list(group)
    counts = df.groupBy(*g, value_col).agg(F.count(F.lit(1)).alias("_cnt")).where(F.col(value_col).isNotNull())
    r = _bucketed(counts, [*g, value_col], partitions).withColumn("_g", _key(g) if g else F.lit(0))
    running = Window.partitionBy("_b", "_g").orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    local = r.withColumn("_before", F.coalesce(F.sum("_cnt").over(running), F.lit(0)))
    totals = r.groupBy("_b", "_g").agg(F.sum("_cnt").alias("_n"))
    w = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", "_g", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # ungrouped: one row per bucket, bounded, broadcast; grouped: the planner sizes the join
    out = local.join(F.broadcast(offsets) if not g else offsets, ["_b", "_g"])
    return out.select(
        *g, value_col, F.col("_cnt").alias("ties"),
        (F.col("_off") + F.col("_before") + (F.col("_cnt") + 1) / 2.0).alias(rank_col),
    )
