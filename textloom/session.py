"""Session helpers.

Cluster settings (shuffle partitions, checkpoint folder, AQE) come from the
session the caller hands in; the helpers here only fill in what is unset, as
in tests and local benches.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from typing import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of an Arrow batch.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Whether a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "textloom") -> SparkSession:
    """Local session for tests and benches (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TEXTLOOM_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets it to a shared file system. Only a local
    session (tests, benches) gets a scratch folder when it is unset; elsewhere
    that is an error, as executors would each write to a disk of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="textloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def ensure_small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, where the session does not say it.

    Spark's own bound of 64 MB counts once in the batch, up to twice more while the JVM's buffer for it grows, and
    again in the Python worker, for each task of an executor.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")


#: Of tables with rows of megabytes: a task holds few of them when it writes or reads, not a hundred.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}


def materialise(df: DataFrame, tag: str = "table", **options) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage: later jobs read files that survive the loss of any executor. ``options`` are the writer's.
    """
    spark = df.sparkSession
    ensure_small_batches(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` wrote and that nothing reads again."""
    for df in tables:
        jvm, files = df.sparkSession._jvm, df._jdf.inputFiles()
        if len(files):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are built and run inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are dear to process: dealt over all cores where its scan has fewer tasks than there are cores.

    A small table in one file, or a large one in few huge row groups, would otherwise be worked on by as many tasks.
    Only the columns that are used travel; a table with enough files is read as it is.  No job runs for the choice.
    """
    df = read_table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
