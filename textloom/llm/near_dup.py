"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on the full shingle sets.

This is banding: a label is a band of values and equal labels make candidates. No order of signatures is sorted, no
common prefix is measured and no depth adapts to a region; depth and number of labels follow from the threshold.

1. Each text becomes its set of distinct word shingles (64-bit hashes). Texts with equal sets form a class; only
   one row per class goes on.
2. The forest: ``trees`` labels of ``depth`` MinHash values each. Classes that share a label are neighbours, and a
   chain links each to the smallest of its label, so the candidate links are linear in the classes, however large
   a label's region is. Their sizes follow from the threshold, at which a pair shares no label in 3e-7 of cases at most.
3. Connected candidates form clusters; all links lie inside them. A cluster of up to ``block`` classes is one group:
   its pairs go through the whole signatures and those that may link two components are
   confirmed on the full sets, most similar first, until no unconfirmed pair between components is left. Only the
   links of a spanning forest are returned.
4. A larger cluster is first linked to its hub, the class that shares the most labels with others (a linear star).
   What the hub leaves over is compared with the whole cluster in blocks, each pair of blocks a task of bounded
   size. No pair is dropped: the star only saves comparisons inside one component.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb
from textloom.llm.common import attach, components, documents, materialise, per_batch

#: Most signature values of a forest that stays within them, the most depth, and how often a pair at the threshold may share no label.
VALUES, DEPTH, MISS = 192, 6, 3e-7
BLOCK = 1024
#: Share of equal signature values below which a pair is not confirmed: 5 standard errors below the threshold, this at least.
SLACK, ERRORS = 0.13, 5

_MULT = (np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, size=1024, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def forest(percent: int) -> tuple[int, int]:
    """``(trees, depth)``: the deepest labels with which a pair at ``percent`` shares none in ``MISS`` of cases at most."""
    share = min(percent, 99) / 100
    for depth in range(DEPTH, 0, -1):
        trees = math.ceil(math.log(MISS) / math.log1p(-share ** depth))
        if trees * depth <= VALUES:
            return max(trees, VALUES // DEPTH), depth
    return min(trees, len(_MULT)), 1


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """MinHash values (16 bits of each minimum) of a set of 64-bit hashes."""
    low = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(low, (hashes[at:at + 4096, None] * _MULT[None, :size]).min(axis=0), out=low)
    return (tb.mix(low) >> np.uint64(48)).astype(np.uint16)


def _sets(batch: pa.RecordBatch, column: str, k: int):
    """Per slice of the batch: ``(row numbers, bounds, hashes)`` of the distinct shingles of each row."""
    raw, off = tb.buffers(batch.column(batch.schema.get_field_index(column)))
    for a, b in tb.slices(off):
        o = off[a:b + 1] - off[a]
        _, _, h, first = tb.words(raw[off[a]:off[b]], o)
        rows, hs = tb.shingles(h, first, k)
        yield range(a, b), np.searchsorted(rows, np.arange(b - a + 1)), hs


def _set_hashes(at: np.ndarray, hashes: np.ndarray) -> list[bytes]:
    """128 bits per set: two sums over its elements."""
    sums = np.zeros((2, len(hashes) + 1), np.uint64)
    np.cumsum(hashes, out=sums[0, 1:])
    np.cumsum(tb.mix(hashes), out=sums[1, 1:])
    return [x.tobytes() for x in tb.mix(sums[:, at[1:]] - sums[:, at[:-1]]).T.copy()]


def _signatures(k: int, size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("sig", pa.binary())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0)
        for rows, at, hs in _sets(batch, "text", k):
            n = np.diff(at)
            sig = [signature(hs[x:y], size).tobytes() if y > x else None for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([ids.slice(rows.start, len(rows)), pa.array(n), pa.array(_set_hashes(at, hs), pa.binary()),
                                              pa.array(sig, pa.binary())], schema=schema)

    return run


def _labels(trees: int, depth: int):
    schema = pa.schema([("label", pa.int64()), ("rep", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        out = []
        for t in range(trees):
            h = np.full(len(sig), t + 1, np.uint64)
            for c in range(t * depth, (t + 1) * depth):
                h = tb.mix(h + sig[:, c].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out.append(h.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.tile(batch.column(0).to_numpy(), trees))], schema=schema)

    return run


class _Union:
    def __init__(self, labels):
        self.up = {x: x for x in labels}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(ids: np.ndarray, comp: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the classes ``ids``, given that equal ``comp`` are linked already.

    Pairs between components whose signatures agree enough are confirmed on the full sets, most similar first.
    ``side`` 0 and 1: only pairs with at least one class of side 1 are looked at.
    """
    union, links = _Union(dict.fromkeys(comp.tolist())), []
    share = percent / 100
    floor = (share - max(SLACK, ERRORS * math.sqrt(share * (1 - share) / sig.shape[1]))) * sig.shape[1]
    queue = []
    for i in np.flatnonzero(side):
        same = (sig == sig[i]).sum(axis=1)
        ok = (same >= floor) & (comp != comp[i])
        ok[:i + 1] &= side[:i + 1] == 0
        j = np.flatnonzero(ok)
        queue.append(np.stack([same[j], np.full(len(j), i), j], axis=1))
    pairs = np.concatenate(queue) if queue else np.zeros((0, 3), np.int64)
    for _, i, j in pairs[np.argsort(-pairs[:, 0], kind="stable")]:
        a, b = union.find(comp[i].item()), union.find(comp[j].item())
        if a != b and _similar(sets[i], sets[j], percent):
            union.up[max(a, b)] = min(a, b)
            links.append((ids[i].item(), ids[j].item()))
    return links


def _group(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(table.num_rows, -1)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        links = confirm(table.column("rep").to_numpy(), table.column("comp").to_numpy(), sig, sets, side, percent)
        return pa.table([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], schema=schema)

    return run


def _hashes(k: int):
    schema = pa.schema([("set_hash", pa.binary()), ("hashes", pa.binary())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, at, hs in _sets(batch, "text", k):
            sets = [hs[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(_set_hashes(at, hs), pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return run


def _star(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        reps, hubs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        own, hub = batch.column(2), batch.column(3)
        ok = [i for i in range(batch.num_rows)
              if _similar(np.frombuffer(own[i].as_py(), np.uint64), np.frombuffer(hub[i].as_py(), np.uint64), percent)]
        return pa.RecordBatch.from_arrays([pa.array([reps[i] for i in ok], pa.int64()), pa.array([hubs[i] for i in ok], pa.int64())], schema=schema)

    return run


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, trees: int | None = None, depth: int | None = None,
                    block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; the set holds the distinct ``k``-word
    shingles (with fewer words the whole sequence). Rows whose sets have ``100 * intersection >= percent * union``
    are linked; without ``trees`` and ``depth`` the forest is that of ``forest(percent)``. ``component_id`` is the smallest id reachable and ``kept`` marks it. A text without words (or null)
    has the empty set and is linked with nothing. Rows with a null id are linked with nothing either; rows that
    repeat an id count as one document (with different texts, a link of either is a link of both). Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trees, depth = trees or forest(percent)[0], depth or forest(percent)[1]
    size = trees * depth
    signed = materialise(rows.mapInArrow(per_batch(_signatures(k, size)), "doc_id long, n_shingles long, set_hash binary, sig binary"), "signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    total = max(1, signed.count())
    classes = materialise(full.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig")), "classes")

    # candidate chains and the clusters they form
    labels = classes.select("rep", "sig").mapInArrow(per_batch(_labels(trees, depth)), "label long, rep long")
    regions = (labels.groupBy("label").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("members"))
               .filter("low < high").select("label", "low", "members"))
    near = materialise(attach(labels, regions, ["label"], F.col("members"), trees * total, F.col("rep")).filter("low is not null"), "neighbours")
    clusters = components(near.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    popular = near.groupBy("rep").agg(F.sum("members").alias("popularity"))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("cluster_n"))
    placed = attach(clusters.withColumnRenamed("node", "rep"), sizes, ["component"], F.col("cluster_n"), total, F.col("rep"))
    placed = placed.join(popular, "rep")

    # the full sets of clustered classes only
    members = placed.join(rows.withColumnRenamed("doc_id", "rep"), "rep").select("text")
    sets = materialise(members.mapInArrow(per_batch(_hashes(k)), "set_hash binary, hashes binary").dropDuplicates(["set_hash"]), "sets")
    cluster = materialise(placed.join(classes.select("rep", "set_hash", "sig"), "rep").join(sets, "set_hash").drop("set_hash"), "clusters")

    link = "a long, b long"
    small = (cluster.filter(F.col("cluster_n") <= block)
             .select("component", "rep", F.col("rep").alias("comp"), F.lit(1).alias("side"), "sig", "hashes"))
    links = materialise(small.groupBy("component").applyInArrow(_group(percent), link), "links")

    large = cluster.filter(F.col("cluster_n") > block)
    if not large.isEmpty():
        # parts of a large cluster; the hub goes to each of them, one row in block // 2
        parts = F.ceil(F.col("cluster_n") / (block // 2)).cast("int")
        large = large.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        best = large.groupBy("component").agg(F.max(F.struct("popularity", (-F.col("rep")).alias("neg"))).alias("best"))
        hub = best.select("component", (-F.col("best.neg")).alias("rep")).join(large.select("component", "rep", "parts", "hashes"), ["component", "rep"])
        hub = (hub.dropDuplicates(["component"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
               .select("component", "part", F.col("rep").alias("hub"), F.col("hashes").alias("hub_hashes")))
        star = large.join(hub, ["component", "part"]).filter("rep <> hub")
        star = materialise(star.select("rep", "hub", "hashes", "hub_hashes").mapInArrow(per_batch(_star(percent)), link), "stars")
        linked = star.select(F.col("a").alias("rep"), F.col("b").alias("comp")).dropDuplicates(["rep"])
        large = large.join(linked, "rep", "left").withColumn("own", F.expr("comp is null").cast("int")).withColumn("comp", F.coalesce("comp", "rep"))
        large = materialise(large.select("component", "rep", "comp", "own", "part", "parts", "sig", "hashes"), "blocks")
        # what the star left over (own) meets each part of its cluster
        left = large.filter("own = 1").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(1))
        left = left.select("component", "part", "with", "rep", "comp", "side", "sig", "hashes")
        needed = left.select("component", "part", "with").distinct()
        right = large.withColumnRenamed("part", "with").join(needed, ["component", "with"])
        right = right.filter("own = 0 or with > part").withColumn("side", F.col("own"))
        right = right.select("component", "part", "with", "rep", "comp", "side", "sig", "hashes")
        crossed = left.unionByName(right).groupBy("component", "part", "with").applyInArrow(_group(percent), link)
        links = links.unionByName(star).unionByName(materialise(crossed, "links"))

    found = components(links)
    final = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    final = final.select("set_hash", "n", F.coalesce("component", "rep").alias("class_component"))
    out = attach(signed.select("doc_id", "n_shingles", "set_hash"), final, ["set_hash"], F.col("n"), total, F.col("doc_id"))
    comp = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the whole ``documents`` table at 85 percent of 3-word shingles."""
    return near_duplicates(documents(spark, sf_dir))
