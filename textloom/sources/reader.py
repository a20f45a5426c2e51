"""Sources, splits and projection (A1-A7); prepared tables (A8) are in ``prepared``."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.operators.ranking import key_at


@dataclass(frozen=True)
class SourceSpec:
    """A1/A2: where a task's rows come from.

    ``path`` is a file or folder (``{split}`` is substituted when given);
    otherwise ``split_col`` selects the split inside one table.  ``aliases``
    maps a canonical split name to the physical one and is applied to loads
    and sizes alike.
    """

    path: str
    format: str = "parquet"
    schema: StructType | str | None = None
    splits: tuple[str, ...] = ("train", "validation", "test")
    split_col: str | None = None
    aliases: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)

    def physical(self, split: str) -> str:
        return self.aliases.get(split, split)

    def read(self, spark: SparkSession, root: str | None = None) -> DataFrame:
        path = self.path if root is None else os.path.join(root, self.path)
        r = spark.read.format(self.format).options(**self.options)
        if self.schema is not None:
            r = r.schema(self.schema)
        return r.load(path)

    def load(self, spark: SparkSession, split: str, root: str | None = None) -> DataFrame:
        phys = self.physical(split)
        if "{split}" in self.path:
            spec = SourceSpec(self.path.replace("{split}", phys), self.format, self.schema, self.splits,
                              None, {}, self.options)
            return spec.read(spark, root)
        df = self.read(spark, root)
        if self.split_col:
            return df.where(F.col(self.split_col) == F.lit(phys))
        return df

    def sizes(self, spark: SparkSession, root: str | None = None) -> DataFrame:
        """A4: rows per split in one aggregation (``split_col`` tables) or per folder."""
        if self.split_col:
            df = self.read(spark, root)
            inv = {v: k for k, v in self.aliases.items()}
            name = F.coalesce(F.element_at(F.create_map(*[x for kv in inv.items() for x in map(F.lit, kv)]),
                                           F.col(self.split_col)), F.col(self.split_col)) if inv else F.col(self.split_col)
            return df.groupBy(name.alias("split")).agg(F.count(F.lit(1)).cast("bigint").alias("num_examples"))
        out = None
        for s in self.splits:
            c = self.load(spark, s, root).agg(F.count(F.lit(1)).cast("bigint").alias("num_examples")) \
                .select(F.lit(s).alias("split"), "num_examples")
            out = c if out is None else out.unionByName(c)
        return out


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """A4 after a fan-out: re-measure rows per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).cast("bigint").alias("num_examples"))


def percent_bound(n: Column, pct: float) -> Column:
    """Boundary ``round(pct · n / 100)`` with half up, in integer arithmetic."""
    num = int(round(pct * 1000))
    return F.floor((n * F.lit(num) * 2 + F.lit(100 * 1000)) / F.lit(2 * 100 * 1000)).cast("bigint")


def slice_split(df: DataFrame, order: list, start_pct: float | None, end_pct: float | None,
                partitions: int | None = None) -> DataFrame:
    """A3 (exact): positional ``[start%:end%]`` slice in ``order`` (a total order).

    A slice is a range of the order key: the keys at its two positions are looked up (``key_at``: a count per bucket
    and a sort of the one bucket that holds the position) and the rows are filtered where they lie, unshuffled.
    """
    n = df.agg(F.count(F.lit(1)).alias("_n")).scalar()
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    cond = F.lit(True)
    if start_pct is not None:
        cond = cond & F.coalesce(key >= key_at(df, order, percent_bound(n, start_pct), partitions), F.lit(False))
    if end_pct is not None:
        cond = cond & F.coalesce(key < key_at(df, order, percent_bound(n, end_pct), partitions), F.lit(True))
    return df.where(cond)


def hash_bucket(key_cols: list, buckets: int = 100, seed: str = "") -> Column:
    """A3 (cheap): stable bucket from the md5 of the key (first 8 hex digits)."""
    key = F.concat_ws("\u0001", F.lit(seed), *[F.col(k).cast("string") for k in key_cols])
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def hash_split(df: DataFrame, key_cols: list, lo_pct: int, hi_pct: int, seed: str = "") -> DataFrame:
    """A3 (cheap, no shuffle): rows whose bucket falls in ``[lo, hi)`` of 100."""
    b = hash_bucket(key_cols, 100, seed)
    return df.where((b >= lo_pct) & (b < hi_pct))


def model_columns(df: DataFrame, columns=("input_ids", "attention_mask", "labels"), all_columns: bool = False,
                  constants: dict | None = None) -> DataFrame:
    """Keep the model inputs (Catalyst prunes the rest at the scan) and add constant inputs."""
    out = df if all_columns else df.select(*[c for c in columns if c in df.columns])
    if constants:
        out = out.withColumns({k: F.lit(v) for k, v in constants.items()})
    return out
