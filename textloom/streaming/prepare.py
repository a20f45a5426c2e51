"""A task's chain on a stream: the same steps, micro-batch by micro-batch, with replayable output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from textloom.session import ensure_checkpoint_dir
from textloom.spec import TaskSpec


def prepare_stream(task: TaskSpec, stream: DataFrame, sequence_length: dict | None = None, all_columns: bool = False) -> DataFrame:
    """The prepared rows of a streaming source: a task's steps are row-local (or joins with a static table) and run unchanged."""
    return task.apply(stream, sequence_length, all_columns)


def drain_prepared(stream: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Write a finite stream (``availableNow``) of prepared rows and return the table.

    A micro-batch overwrites the folder of its own number, so a batch that is replayed after a failure replaces its
    rows instead of adding them again.  Offsets are checkpointed below ``root`` (a folder below ``spark.checkpoint.dir``
    unless given): a second call with the same root goes on where the first ended and reads only new files.
    """
    spark = stream.sparkSession
    root = (root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}").rstrip("/")
    out = f"{root}/rows"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    q = (stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state")
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/*")
