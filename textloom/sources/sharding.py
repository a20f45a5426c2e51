"""Epoch order, shards, batches and collation.

The reference shuffles indices per epoch and deals them to ranks
(``indices[rank::world]``) in fixed-size batches.  Here the epoch order is a
hash of ``(seed, epoch, id)``; the global position in that order comes from
``global_index`` (buckets are ranges of the hash), so ``shard = idx % world`` and
``pos = idx div world``.  Shards are not padded with repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_key(id_cols: list, epoch: int, seed: int = 0) -> Column:
    """Per-epoch sort key, a 64-bit value from md5 of ``seed:epoch:id`` (id breaks ties)."""
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(c).cast("string") for c in id_cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def assign_shards(df: DataFrame, id_cols: list, epoch: int, world_size: int, batch_size: int, seed: int = 0,
                  partitions: int | None = None) -> DataFrame:
    """Add ``shard``, ``pos`` (position inside the shard) and ``batch``."""
    from textloom.operators.ranking import global_index

    keyed = df.withColumn("_ek", epoch_key(id_cols, epoch, seed))
    # the hashed key is even, so its leading part is the bucket
    idx = global_index(keyed, ["_ek", *id_cols], "_gidx", partitions,
                       bucket=lambda n: F.floor(F.col("_ek") / F.lit(float(1 << 60)) * n).cast("int"))
    return idx.withColumns({
        "shard": (F.col("_gidx") % world_size).cast("int"),
        "pos": F.floor(F.col("_gidx") / world_size).cast("bigint"),
    }).withColumn("batch", F.floor(F.col("pos") / batch_size).cast("bigint")).drop("_ek", "_gidx")


def collate(df: DataFrame, keys: list[str], pos_col: str, value_cols: list[str], strict: bool = False) -> DataFrame:
    """One row per batch, each value column becomes a list in position order.

    A batch is at most ``batch_size`` rows, so the group is bounded.  With
    ``strict`` a batch whose array column lengths differ raises an error.
    """
    packed = F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("_p"), *[F.col(c) for c in value_cols])))
    out = df.groupBy(*keys).agg(packed.alias("_rows"))
    def field(name):
        return F.transform("_rows", lambda s: s[name])

    cols = {c: field(c) for c in value_cols}
    out = out.withColumns(cols)
    if strict:
        checks = {}
        for c in value_cols:
            dt = dict(df.dtypes)[c]
            if dt.startswith("array"):
                sizes = F.transform(F.col(c), lambda a: F.size(a))
                checks[c] = F.when(F.array_min(sizes) != F.array_max(sizes),
                                   F.raise_error(F.lit(f"collate: sequences in {c} must have equal size"))) \
                    .otherwise(F.col(c))
        out = out.withColumns(checks)
    return out.drop("_rows")
