"""Running metric meter over a stream (M17 on Structured Streaming).

The row transforms are row-local, so they run unchanged on a streaming
DataFrame; the meter is a streaming aggregation whose state is the running
``Σ score·count`` and ``Σ count`` per key — exactly what the reference's meter
keeps in memory, but checkpointed by Spark and recoverable after a failure.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, folder: str, table: str, schema: StructType) -> DataFrame:
    """File stream over one table of a folder, be it one parquet file or a folder of them (schema given, no inference).

    The source takes a folder, and a file only by a pattern; the pattern of one name fits both.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder.rstrip('/')}/{{{table}.parquet}}")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def running_meter(events: DataFrame, key: str, hit, name: str) -> DataFrame:
    """Streaming aggregation: per key ``score = 100·Σhit/Σn`` and ``count = Σn``."""
    g = events.groupBy(F.col(key).alias("key")).agg(
        F.sum(hit.cast("long")).alias("hits"), F.count(F.lit(1)).alias("n"))
    return g.select(F.lit(name).alias("metric"), "key",
                    (F.col("hits") * 100.0 / F.col("n")).alias("score"), F.col("n").cast("bigint").alias("count"))


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Drain a finite stream (``availableNow``) in update mode and return the latest row per key.

    Each micro-batch writes only the keys it changed, into a folder of its own below ``spark.checkpoint.dir``, so
    the driver holds no state and a repeated micro-batch replaces its own folder. The query checkpoints there as
    well: a restart resumes from the committed offsets and state instead of recounting.  A stream without files
    gives no rows.
    """
    root = (checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}").rstrip("/")
    out = f"{root}/rows"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state")
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]) \
        .write.mode("overwrite").parquet(f"{out}/batch=-1")  # the folder is there even if no batch was
    rows = spark.read.schema(f"{_ddl(stream.schema)}, batch INT").parquet(out)
    latest = rows.groupBy("metric", "key").agg(F.max_by(F.struct(*stream.columns), "batch").alias("r"))
    return latest.select("r.*")
