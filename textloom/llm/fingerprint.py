"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

A window of ``WINDOW`` bytes slides over the UTF-8 text; the triplets that hold its newest byte and two of the
earlier ones are hashed into ``BUCKETS`` counters. The digest has a header (a code of the length on a log scale)
and, per bucket, how many of the three quartiles of all counts the bucket exceeds (two bits). Two digests are
compared by the summed differences of their codes, relative to the most they could be, so the score is bounded.
"""

from __future__ import annotations

import hashlib
import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import documents, shuffle_partitions

BUCKETS = 256
WINDOW = 8
#: Distances from the newest byte of a window to the other two bytes of a triplet.
_PAIRS = [(1, 2), (2, 5), (3, 7), (4, 6)]
_SALT = [np.uint32(2654435761 * (2 * i + 1) % (1 << 32)) for i in range(len(_PAIRS))]
_LEN_STEP = math.log(1.5) / 4
_SHIFT = np.uint32(32 - int(math.log2(BUCKETS)))
_QUARTILES = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed triplets of ``data`` per bucket; a text shorter than the window is padded with zeros.

    Works through the text in steps, so the memory beyond the text does not grow with it.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if 0 < len(raw) < WINDOW:
        raw = np.concatenate([raw, np.zeros(WINDOW - len(raw), np.uint8)])
    out = np.zeros(BUCKETS, dtype=np.int64)
    step = 1 << 18
    for at in range(0, max(0, len(raw) - WINDOW + 1), step):
        b = raw[at:at + step + WINDOW - 1].astype(np.uint32)
        n = len(b) - WINDOW + 1
        new = b[WINDOW - 1:] << np.uint32(16)
        for (i, j), salt in zip(_PAIRS, _SALT):
            t = new | b[WINDOW - 1 - i:][:n] << np.uint32(8)
            t |= b[WINDOW - 1 - j:][:n]
            t *= np.uint32(2246822519)
            t ^= salt
            t ^= t >> np.uint32(15)
            t *= np.uint32(3266489917)
            t >>= _SHIFT
            out += np.bincount(t, minlength=BUCKETS)
    return out


def joined_counts(head: bytes, head_counts: np.ndarray, tail: bytes) -> np.ndarray:
    """``bucket_counts(head + tail)`` from the counts of the head."""
    if len(head) < WINDOW:
        return bucket_counts(head + tail)
    return head_counts + bucket_counts(head[1 - WINDOW:] + tail) if tail else head_counts


def quartile_codes(n_bytes: int, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """``(length code, bucket codes)``: per bucket, how many of the quartiles of all counts it exceeds."""
    marks = np.partition(counts, _QUARTILES)[_QUARTILES]
    length = min(255, round(math.log1p(n_bytes) / _LEN_STEP))
    return length, np.searchsorted(marks, counts, side="left")


def digest(code: tuple[int, np.ndarray]) -> str:
    """Hex form: one byte for the length, then four buckets a byte."""
    c = code[1].astype(np.uint8)
    packed = c[0::4] | c[1::4] << 2 | c[2::4] << 4 | c[3::4] << 6
    return f"{code[0]:02x}{packed.tobytes().hex()}"


def fingerprint(data: bytes) -> str:
    """Digest of a text; equal texts have equal digests."""
    return digest(quartile_codes(len(data), bucket_counts(data)))


def codes(hex_digest: str) -> tuple[int, np.ndarray]:
    """The codes that ``digest`` wrote."""
    raw = np.frombuffer(bytes.fromhex(hex_digest), dtype=np.uint8)
    return int(raw[0]), np.stack([raw[1:] >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel().astype(np.int64)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Bounded score of two codes: 1 for equal ones, towards 0 the more bucket codes and lengths differ.

    Differences of the bucket codes are scaled by what two unrelated orders of the same codes would differ by, so
    unrelated texts come near 0 rather than near one half.
    """
    diff = int(np.abs(a[1] - b[1]).sum())
    over_a = [np.count_nonzero(a[1] > k) / BUCKETS for k in range(3)]
    over_b = [np.count_nonzero(b[1] > k) / BUCKETS for k in range(3)]
    chance = BUCKETS * sum(x * (1 - y) + y * (1 - x) for x, y in zip(over_a, over_b))
    same = 1.0 if diff == 0 else max(0.0, 1.0 - diff / chance) if chance else 0.0
    return same / (1.0 + abs(a[0] - b[0]) / 16.0)


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _edited(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, doc_id, text); each part ends with a copy of the row that follows it (``tail``)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])
    out: list[tuple] = []
    held = None  # the row that waits for its successor, its text cut where the edit begins
    for batch in rows:
        part_ids, ids, tails = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "doc_id", "tail"))
        texts = batch.column(batch.schema.get_field_index("text"))
        for part, doc_id, tail, cell in zip(part_ids, ids, tails, texts):
            text = cell.as_py()
            n, data = len(text), text.encode()
            head = text[:n - n // 4].encode()
            counts = bucket_counts(head)
            code = quartile_codes(len(data), joined_counts(head, counts, data[len(head):]))
            if held is not None and held[0] == part:
                _, i, m, kept, kept_counts, own = held
                new = text[:m // 4].encode()
                edited = quartile_codes(len(kept) + len(new), joined_counts(kept, kept_counts, new))
                out.append((i, m, hashlib.sha256(kept + new).hexdigest(), digest(own), digest(edited),
                            likeness(own, edited), likeness(own, code)))
            held = None if tail else (part, doc_id, n, head, counts, code)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
                out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprint of each text, of its edited text and their likeness, and the likeness to the next document.

    The edited text replaces the last ``n // 4`` code points by the first as many (or all) of the next document
    in ascending ``doc_id``; after the last document comes the first. Null text counts as empty; null ids stand
    first; rows that share an id stand in the order of their texts. A lone document is its own successor. Columns
    besides the two named are ignored; an empty table gives an empty result.

    One shuffle of the text: approximate quantiles of the ids (real ids, at most ``parts``) start the parts, and
    the row that starts a part also closes the part before, so a task sees all successors it needs while it
    streams through sorted rows with one text in hand.
    """
    spark = docs.sparkSession
    parts = parts or max(1, min(4096, 4 * shuffle_partitions(spark)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # null ids stand first: below every id
    at = rows.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("at"))
    found = at.agg(F.min("at").alias("lo"), F.percentile_approx("at", [i / parts for i in range(1, parts)] or [0.5], 10000).alias("qs")).first()
    if found.lo is None:
        return spark.createDataFrame([], _OUT)
    starts = sorted({found.lo, *found.qs}) if parts > 1 else [found.lo]
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    marks = F.array(*[F.lit(x) for x in starts])
    part = F.size(F.filter(marks, lambda x: x <= key)) - 1
    before = F.when(F.array_contains(marks, key), F.pmod(F.col("part") - 1, F.lit(len(starts))))
    placed = rows.withColumn("part", part)
    placed = placed.withColumn("to", F.explode(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")),
                                                       F.struct(before.alias("part"), F.lit(True).alias("tail")))))
    placed = placed.select(F.col("to.part").alias("part"), F.col("to.tail").alias("tail"), "doc_id", "text").filter("part is not null")
    dealt = placed.repartition(max(1, min(len(starts), shuffle_partitions(spark))), "part")
    dealt = dealt.sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_edited, _OUT)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the whole ``documents`` table and of its edited texts."""
    return fingerprints(documents(spark, sf_dir))
