"""Joins against hot keys, connected components and batch loops shared by the operators of this subpackage."""

from __future__ import annotations

from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import LARGE_ROWS, discard, materialise, read_table, released_shuffles

__all__ = ["LARGE_ROWS", "attach", "components", "discard", "documents", "materialise", "per_batch", "read_table", "released_shuffles", "shuffle_partitions"]

#: A key is hot if it holds at least one row in HOT; at most HOT keys can, so their rows may be broadcast.
HOT = 2000
#: Edges per file between two rounds of ``components``: few edges need few tasks.
EDGES_PER_FILE = 200_000


def documents(spark, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def attach(rows: DataFrame, table: DataFrame, key: list[str], weight: Column, total: int, spread: Column) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per ``key``) that no hot key can overload.

    ``key`` is one column (bigint, string or binary). ``weight`` is the number of ``rows`` of a key and ``total``
    their sum, so at most ``HOT`` keys satisfy ``weight * HOT >= total``: those are joined by a broadcast of that
    proven size. Their rows still pass the shuffled join of the others, but dealt by a hash of ``spread`` instead
    of their key.
    """
    (name,) = key
    values = [c for c in table.columns if c != name]
    is_hot = weight * F.lit(HOT) >= F.lit(total)
    hot = table.filter(is_hot).select(name, *[F.col(c).alias(f"__hot_{c}") for c in values], F.lit(True).alias("__hit"))
    out = rows.join(F.broadcast(hot), name, "left")
    # a hot row's key is replaced, not only salted: a table that is laid out by its key makes Spark deal rows by
    # the key alone. The second column keeps replaced keys from matching anything.
    kind = dict(table.dtypes)[name]
    other = F.xxhash64(spread)
    other = other if kind == "bigint" else other.cast("string").cast(kind)
    hit = F.col("__hit").isNotNull()
    out = out.withColumn("__dealt", F.when(hit, other).otherwise(F.col(name))).withColumn("__own", hit.cast("int"))
    cold = table.filter(~is_hot).withColumnRenamed(name, "__dealt").withColumn("__own", F.lit(0))
    out = out.join(cold, ["__dealt", "__own"], "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"__hot_{c}"), F.col(c)).alias(c) for c in values])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)``, the component being its smallest node.

    Alternates large-star and small-star steps until nothing changes. Each round is written to the shared
    folder, so lineage stays short and a lost executor costs one round at most. Only a count and a checksum
    reach the driver. Work is a few aggregations and joins of the edge list per round; the number of rounds
    grows with the logarithm of the largest component, not with its diameter.
    """
    most = shuffle_partitions(edges.sparkSession)

    def written(df: DataFrame, n: int) -> DataFrame:
        return materialise(df.coalesce(max(1, min(most, n // EDGES_PER_FILE))), "edges")

    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e, "edges")
    n, state = e.count(), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.filter("a <> m").select("a", F.col("m").alias("b"))).filter("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        e = written(small, n)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        n = now.n
        if state is not None and (now.n, now.s) == state:
            break
        state = (now.n, now.s)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return star.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | Iterator]) -> Callable:
    """Loop for ``mapInArrow``: ``fn`` maps a batch to a batch, a table or an iterator of them; empty batches pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn(batch)
            for part in [out] if isinstance(out, (pa.RecordBatch, pa.Table)) else out:
                yield from part.to_batches() if isinstance(part, pa.Table) else [part]

    return run
