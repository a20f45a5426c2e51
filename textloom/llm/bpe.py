"""BPE encoding and decoding by tree concatenation.

A text longer than ``LEAF`` characters is cut in halves until the pieces are short; leaves are encoded on their own,
and halves are put together at each join by encoding a window around it. A window starts and ends on boundaries that
both sides must confirm: its encoding has to agree with the left side up to a shared word boundary and with the
right side from a shared word boundary on. While they don't agree the window grows, at the latest to both whole
sides, so the result is the encoding of the unsplit text in every case.

A leaf is encoded word by word (words end at ASCII white space, which the vocabulary's normaliser and splitter
never carry across), and each distinct word of a task is given to the tokenizer library once.
"""

from __future__ import annotations

import hashlib
import marshal
import os
import re
from bisect import bisect_left
from itertools import islice
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import documents, shuffle_partitions

#: Most characters that are encoded without a split.
LEAF = 1 << 16
#: Texts beyond this are cut into rows of this many characters that different tasks encode.
PIECE = 1 << 20
#: Distinct words that a task remembers, and that it keeps of them when these get too many and for its worker's next task.
CACHE, KEPT = 3 << 17, 1 << 18
#: First width of the window on each side of a join, in characters.
WINDOW = 64

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Encoder:
    """Encoder for one vocabulary file of the ``tokenizers`` library, with a bounded memory of words.

    ``words(text)`` of a piece gives ``(starts, entries)``: where each word starts and what it encodes to. An entry
    is ``(number of ids, ids as text, tokens as text)``: ready for the digest of the ids and of the decoded text.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, tuple[int, str, str]] = {}
        self.left = b""

    def learn(self, words: list[str]) -> None:
        """Remember ``words``. A final full stop or comma behind plain letters is a piece of its own to the splitter, and
        the normaliser lower-cases, so such words are put together from the entries of their lower-case stem and mark."""
        if len(self.known) + len(words) > CACHE:
            self.known = self._first()
        parts = []
        for w in words:
            stem, mark = w, ""
            if w.isascii() and "<|" not in w:
                if w[-1] in ".," and w[:-1].isalpha():
                    stem, mark = w[:-1], w[-1]
                stem = stem.lower()
            parts.append((stem, mark))
        self._encode([x for x in dict.fromkeys([*(p[0] for p in parts), ".", ","]) if x not in self.known])
        known = self.known
        for w, (stem, mark) in zip(words, parts):
            e = known[stem]
            if mark:
                m = known[mark]
                e = (e[0] + m[0], f"{e[1]} {m[1]}", f"{e[2]} {m[2]}")
            known[w] = e

    def _encode(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            decoded = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            for w, i, d in zip(part, ids, decoded):
                self.known[w] = (len(i), " ".join(map(str, i)), d)

    def entries(self, words: list[str]) -> list[tuple[int, str, str]]:
        """The entries of ``words``; new ones are encoded in one call of the library."""
        known = self.known
        out = [known.get(w) for w in words]
        if None in out:
            missing = list(dict.fromkeys(w for w, e in zip(words, out) if e is None))
            self.learn(missing)
            known = self.known
            if len(missing) > CACHE or any(w not in known for w in words):
                local = {w: e for w, e in zip(words, out) if e is not None}
                out = [known.get(w) or local[w] for w in words]
            else:
                out = [known[w] for w in words]
        return out

    def resume(self) -> None:
        """At a task's start: the words that the worker's last task left."""
        if self.left:
            self.known, self.left = marshal.loads(self.left), b""

    def _first(self) -> dict[str, tuple[int, str, str]]:
        """The words learned first: common ones are met early."""
        return dict(islice(self.known.items(), KEPT))

    def release(self) -> None:
        """At a task's end: the words learned first stay, packed. Spark hands the worker on to other steps, beside whose
        data a full memory of words does not fit."""
        self.left, self.known = marshal.dumps(self._first()), {}
        pa.default_memory_pool().release_unused()

    def leaf(self, text: str, at: int) -> tuple[list[int], list[tuple[int, str, str]]]:
        starts = [m.start() + at for m in _WORD.finditer(text)]
        return starts, self.entries(_WORD.findall(text))


Encoded = tuple[list[int], list[tuple[int, str, str]]]


def join(encoder: Encoder, text: str, lo: int, mid: int, hi: int, left: Encoded, right: Encoded) -> Encoded:
    """Encoding of ``text[lo:hi]`` from those of ``text[lo:mid]`` and ``text[mid:hi]``.

    The window starts where a word of the left side starts and ends where one of the right side does; a word is
    a boundary that both sides confirm if it starts behind white space and the window, grown once more, gives the
    same entry for it. Otherwise the window is doubled, up to both whole sides.
    """
    width = WINDOW
    while True:
        a, b = max(lo, mid - width), min(hi, mid + width)
        i = bisect_left(left[0], a)
        j = bisect_left(right[0], b)
        start = left[0][i] if i < len(left[0]) else mid
        end = right[0][j] if j < len(right[0]) else hi
        whole_left, whole_right = a == lo, b == hi
        if whole_left:
            i, start = 0, lo
        if whole_right:
            j, end = len(right[0]), hi
        window = encoder.leaf(text[start:end], start)
        # the first word of the window must be the left side's word, the last one the right side's
        agrees_left = whole_left or (i < len(left[0]) - 1 and window[0][:1] == left[0][i:i + 1] and window[1][0] == left[1][i]
                                     and text[start - 1] in " \t\n\v\f\r")
        agrees_right = whole_right or (1 < j < len(right[0]) and window[0][-1] == right[0][j - 1] and window[1][-1] == right[1][j - 1]
                                       and text[end - 1] in " \t\n\v\f\r")
        if agrees_left and agrees_right:
            return left[0][:i] + window[0] + right[0][j:], left[1][:i] + window[1] + right[1][j:]
        width *= 2


def encode(encoder: Encoder, text: str, lo: int = 0, hi: int | None = None, leaf: int = LEAF) -> Encoded:
    """Tree concatenation over ``text[lo:hi]``."""
    hi = len(text) if hi is None else hi
    if hi - lo <= leaf:
        return encoder.leaf(text[lo:hi], lo)
    mid = (lo + hi) // 2
    return join(encoder, text, lo, mid, hi, encode(encoder, text, lo, mid, leaf), encode(encoder, text, mid, hi, leaf))


def digests(entries: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    """``(number of ids, SHA-256 of the ids joined by a space, SHA-256 of the decoded text)``."""
    full = [e for e in entries if e[0]]
    ids, text = " ".join([e[1] for e in full]), " ".join([e[2] for e in full])
    return sum([e[0] for e in full]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    """The task's encoder; the vocabulary file is found on the machine that runs the task."""
    if name not in _ENCODERS:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _ENCODERS[name] = Encoder(path)
    return _ENCODERS[name]


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_TEXTS = pa.schema([("doc_id", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])
_PIECE = pa.schema([("row", pa.int64()), ("piece", pa.int64()), ("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
                    ("ids", pa.list_(pa.string())), ("decoded", pa.list_(pa.string())), ("text", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>",
             pa.list_(pa.int32()): "array<int>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _result(doc_id, entries, full: bool) -> tuple:
    if full:
        some = [e for e in entries if e[0]]
        return doc_id, " ".join(e[1] for e in some), " ".join(e[2] for e in some)
    return (doc_id, *digests(entries))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def bpe(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", full: bool = False, id_col: str = "doc_id",
        text_col: str = "text", leaf: int = LEAF, piece: int = PIECE) -> DataFrame:
    """Encode and decode every text as the ``tokenizers`` library does with ``vocabulary`` (a name of the public set
    or a path that each machine has), without adding special tokens, truncation or padding.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``; with ``full`` the ids (decimal, joined by a space) and
    the decoded text instead of the digests: ``doc_id, ids, decoded``. Null text counts as empty and encodes to no
    ids; null and repeated ids are kept, one row out per row in. Other columns are ignored; an empty table gives an
    empty result. Texts up to ``piece`` characters are encoded where they are read. Longer ones are cut into rows of
    ``piece`` characters that are dealt over the cluster, encoded in parallel, and joined per text.
    """
    schema = _TEXTS if full else _DIGEST
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary)
        enc.resume()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                part = texts.slice(at, 256).to_pylist()
                words = [_WORD.findall(t) if len(t) <= leaf else None for t in part]
                # one call of the library for the new words of many texts
                new = set().union(*(w for w in words if w)).difference(enc.known)
                if new:
                    enc.learn(list(new))
                found = [encode(enc, t, leaf=leaf)[1] if w is None else enc.entries(w) for t, w in zip(part, words)]
                yield _batch([_result(i, e, full) for i, e in zip(ids[at:at + 256], found)], schema)
        enc.release()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary)
        enc.resume()
        for batch in batches:
            for row in batch.to_pylist():
                starts, entries = encode(enc, row["text"], leaf=leaf)
                yield _batch([(row["row"], row["piece"], starts, [e[0] for e in entries], [e[1] for e in entries],
                               [e[2] for e in entries], row["text"])], _PIECE)
        enc.release()

    def whole(key, table):
        enc = _encoder(vocabulary)
        parts = sorted(table.to_pylist(), key=lambda r: r["piece"])
        text, at, spans = "".join(p["text"] for p in parts), 0, []
        for p in parts:
            spans.append((at, at + len(p["text"]), ([s + at for s in p["starts"]], list(zip(p["sizes"], p["ids"], p["decoded"])))))
            at += len(p["text"])
        while len(spans) > 1:  # neighbours two by two, as in the tree
            spans = [(x[0], y[1], join(enc, text, x[0], x[1], y[1], x[2], y[2])) if y else x
                     for x, y in zip(spans[::2], [*spans[1::2], None][:(len(spans) + 1) // 2])]
        return pa.Table.from_batches([_batch([_result(parts[0]["doc_id"], spans[0][2][1], full)], schema)])

    few = rows.filter(F.length("text") <= piece).mapInArrow(short, _ddl(schema))
    many = (rows.filter(F.length("text") > piece).withColumn("row", F.monotonically_increasing_id())
            .select("row", "doc_id", F.posexplode(F.expr(
                f"transform(sequence(0, cast((length(text) - 1) div {piece} as int)), i -> substring(text, i * {piece} + 1, {piece}))"
            )).alias("piece", "text")).select("row", "doc_id", F.col("piece").cast("long").alias("piece"), "text")
            .repartition(shuffle_partitions(docs.sparkSession), "row", "piece"))
    encoded = _with_id(many, pieces)
    long = encoded.groupBy("row").applyInArrow(whole, _ddl(schema))
    return few.unionByName(long)


def _with_id(many: DataFrame, pieces) -> DataFrame:
    """``pieces`` over the rows, ``doc_id`` carried along."""
    ddl = _ddl(_PIECE) + ", doc_id long"
    schema = _PIECE.append(pa.field("doc_id", pa.int64()))

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for n, out in enumerate(pieces([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, ids.slice(n, 1)], schema=schema)

    return many.mapInArrow(run, ddl)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of the whole ``documents`` table with the public word vocabulary."""
    return bpe(documents(spark, sf_dir))
