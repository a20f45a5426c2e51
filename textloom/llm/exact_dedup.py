"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a Parquet table with one row per distinct text: SHA-256 digest, the row that stays and the size of
its group when it came in. It is bucketed and sorted by the digest, so the sort-merge joins that find new texts read it
without a shuffle. A batch of new data is pre-aggregated by digest and joined with the index once; what the index
lacks is appended in the same layout. Rows then meet the digests of their own batch only, however large the index is.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import attach, documents, materialise, shuffle_partitions
from textloom.session import ensure_checkpoint_dir

_SCHEMA = T.StructType([
    T.StructField("digest", T.StringType()),
    T.StructField("keep_id", T.LongType()),
    T.StructField("group_size", T.LongType()),
])


class DigestIndex:
    """Bucketed and sorted digest table in a shared folder.

    ``path`` defaults to a new folder below ``spark.checkpoint.dir``; give the path of an earlier index to go on
    with it (``buckets`` must then be its number of buckets; another number raises ``ValueError``). ``buckets`` is
    fixed for the life of an index: take enough that a bucket of the expected number of distinct texts fits a task.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or max(8, shuffle_partitions(spark))
        if path is not None:
            self._check(path)
        self.path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/digest-index-{uuid.uuid4().hex}"
        self.name = f"digest_index_{uuid.uuid4().hex}"
        cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _SCHEMA)
        spark.sql(f"CREATE TABLE {self.name} ({cols}) USING parquet CLUSTERED BY (digest) "
                  f"SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def _check(self, path: str) -> None:
        """The rows of one file of an earlier index must hash to the bucket that its name tells."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files = [str(s.getPath()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
        files = [(f, m) for f in files if (m := re.search(r"_(\d{5})\.c\d+", f))]
        if files:
            file, bucket = files[0]
            own = F.pmod(F.hash("digest"), F.lit(self.buckets)) == int(bucket.group(1))
            if not self.spark.read.schema(_SCHEMA).parquet(file).filter(~own).isEmpty():
                raise ValueError(f"the index at {path} does not have {self.buckets} buckets")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def resolve(self, groups: DataFrame) -> DataFrame:
        """``groups(digest, keep_id, group_size)`` with ``new`` (the index lacks the digest); a digest that it has gets the
        ``keep_id`` of the index (sort-merge join on the index's layout)."""
        held = self.read().select("digest", F.col("keep_id").alias("__held"), F.lit(True).alias("__seen"))
        out = groups.join(held.hint("merge"), "digest", "left")
        return out.select("digest", F.when(F.col("__seen"), F.col("__held")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size",
                          F.col("__seen").isNull().alias("new"))

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` whose digest the index lacks (sort-merge anti-join)."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add the unseen ``groups`` in the layout of the index; what it holds already is passed over, so a repeated
        call adds nothing."""
        (self.unseen(groups).select(*_SCHEMA.names).repartition(self.buckets, "digest")
         .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .mode("append").option("path", self.path).saveAsTable(self.name))

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate ``docs`` against ``index`` and append what is new to it.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Of equal texts of one call
    the row with the largest ``doc_id`` stays; a text that the index already held keeps the row of the earlier
    call, so none of the new rows is kept, null ids included. ``group_size`` counts the rows of this call. Null text
    counts as empty. A null ``doc_id`` stays only if no other row of its group has one. Rows that repeat a ``doc_id``
    and a text count in ``group_size`` and share their fate. Columns besides the two named are ignored, whatever their
    names; an empty table gives an empty result. The result does not read the index, which may be closed.
    """
    rows = digests(docs, id_col, text_col)
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialise(index.resolve(groups), "digests")
    index.append(groups.filter("new"))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first().n
    out = attach(rows, groups, ["digest"], F.col("group_size"), total, F.col("doc_id"))
    return out.select("doc_id", "keep_id", "group_size",
                      (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
                      F.col("digest").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of the whole ``documents`` table against a new index."""
    index = DigestIndex(spark)
    try:
        return exact_dedup(documents(spark, sf_dir), index)
    finally:
        index.close()


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
