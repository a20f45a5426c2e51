"""Prepared tables made once and shared.

A prepared table lives below one root folder: every attempt writes a data folder of its own, and a small marker file,
renamed into place when the data is complete, says which folder holds the table of a *fingerprint* (plan, schema, input
files with sizes and times, version).  A marker therefore always names whole data: a crashed attempt leaves an unnamed
folder that nobody reads, a second call finds the marker and reads, and a changed plan or input gets a table of its own
while readers of the old one go on undisturbed.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def plan_text(df: DataFrame) -> str:
    """The analysed plan with expression ids renumbered in order of appearance, so that it reads the same in every session."""
    seen: dict[str, int] = {}
    text = df._jdf.queryExecution().analyzed().toString()
    return re.sub(r"#(\d+)", lambda m: f"#{seen.setdefault(m.group(1), len(seen))}", text)


def input_states(df: DataFrame) -> list[tuple[str, int, int]]:
    """``(file, length, modification time)`` of all input files; each folder is listed once."""
    spark = df.sparkSession
    wanted = sorted(df.inputFiles())
    found = {}
    for folder in sorted({f.rsplit("/", 1)[0] for f in wanted}):
        fs, p = _fs(spark, folder)
        for s in fs.listStatus(p):
            found[s.getPath().getName()] = (s.getLen(), s.getModificationTime())
        for f in [w for w in wanted if w.rsplit("/", 1)[0] == folder]:
            # file names come as URIs; the listing has the plain name
            name = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)).getName()
            found[f] = found[name]
    return [(f, *found[f]) for f in wanted]


def fingerprint(df: DataFrame, version: str = "") -> str:
    """What the table is made of: plan, schema, state of the input files, and the caller's ``version`` (for what a plan does
    not show: code of Python functions, rows of a table that is not read from files)."""
    parts = [plan_text(df), df.schema.json(), json.dumps(input_states(df)), version]
    return hashlib.sha256("\x00".join(parts).encode()).hexdigest()


def _marker(path: str, key: str) -> str:
    return f"{path.rstrip('/')}/{key}.json"


def find_prepared(spark: SparkSession, path: str, key: str) -> tuple[str, StructType] | None:
    """``(data folder, schema)`` of a complete table, or None."""
    fs, p = _fs(spark, _marker(path, key))
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        note = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    data = f"{path.rstrip('/')}/{note['data']}"
    fs, p = _fs(spark, data)
    return (data, StructType.fromJson(note["schema"])) if fs.exists(p) else None


def _read(spark: SparkSession, found: tuple[str, StructType]) -> DataFrame:
    data, schema = found
    return spark.read.schema(schema).parquet(data).select(*schema.names)


def prepare_once(df: DataFrame, path: str, split_col: str | None = "split", version: str = "") -> DataFrame:
    """The table of ``df`` below ``path``: read if a complete one is there, else written (partitioned by ``split_col``) and read.

    ``path`` must be on the file system that all readers share.  Two writers at once do no harm: each has its own
    data folder and the marker names one of them.
    """
    spark, key = df.sparkSession, fingerprint(df, version)
    found = find_prepared(spark, path, key)
    if found is None:
        name = f"data-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(split_col) if split_col else df.write
        writer.parquet(f"{path.rstrip('/')}/{name}")
        note = json.dumps({"data": name, "schema": df.schema.jsonValue()}).encode()
        fs, draft = _fs(spark, f"{path.rstrip('/')}/.{key}-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(note))
        finally:
            out.close()
        final = _fs(spark, _marker(path, key))[1]
        if not fs.rename(draft, final) and find_prepared(spark, path, key) is None:
            # a marker whose data is gone stands in the way
            fs.delete(final, False)
            if not fs.rename(draft, final):
                raise OSError(f"could not put the marker {final} in place")
        found = find_prepared(spark, path, key)
    return _read(spark, found)


def await_prepared(df: DataFrame, path: str, version: str = "", timeout: float = 3600.0, poll: float = 1.0) -> DataFrame:
    """The table that another process prepares with ``prepare_once``: waits for its marker, never writes."""
    spark, key = df.sparkSession, fingerprint(df, version)
    end = time.monotonic() + timeout
    while (found := find_prepared(spark, path, key)) is None:
        if time.monotonic() >= end:
            raise TimeoutError(f"no prepared table {key} below {path} within {timeout} s")
        time.sleep(poll)
    return _read(spark, found)
