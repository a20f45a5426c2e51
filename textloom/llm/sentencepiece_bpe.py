"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda of adjacent symbol pairs.

All adjacent pairs of symbols whose concatenation is a piece stand in an agenda (a heap) ordered by the piece's score,
then by place. The best pair is merged, its two new neighbour pairs join the agenda, entries that a merge has outdated
are passed over when they surface, and what is left when the agenda is empty is the encoding. Characters that are no
piece fall back to their bytes.

Two characters that stand side by side in no piece can never be merged across, so a text is cut there first (before
each word, around line ends and most marks); the cuts are read from the vocabulary. Each distinct unit of a task
passes the agenda once. Every batch's new units are also encoded by the ``sentencepiece`` library in one call: where
it differs its ids count, and the row's ``n_differ`` tells how many of its units did.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import documents

SPACE = "▁"
#: Distinct units that a task remembers.
CACHE = 1 << 19
#: Symbols of a unit whose agenda is a list; longer ones have a heap.
SHORT = 32
NEVER = 1 << 40
#: Characters that are cut into units at a time.
BLOCK = 1 << 18


class PieceEncoder:
    """Agenda encoder for one merge-type model file of the ``sentencepiece`` library.

    Holds for models that only put a space mark in front and replace spaces by it (no other normalisation, no
    user-defined or unused pieces), with byte fallback; others raise ``ValueError``.
    """

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = self.library = SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        normal = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        if any(sp.is_unused(i) for i in normal) or len(self.byte) != 256 or sp.normalize("  A\nÅb  ") != SPACE * 3 + "A\nÅb" + SPACE * 2:
            raise ValueError("a byte-fallback model that only marks spaces is needed")
        self.ids = {sp.id_to_piece(i): i for i in normal}
        order = {s: n for n, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        self.rank = {sp.id_to_piece(i): order[sp.get_score(i)] for i in normal}
        self.text = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.eos = sp.eos_id()
        self._learn_cuts([p for p in self.ids if len(p) > 1])
        #: a character of no longer piece: the library keeps what follows it apart from its own mark in front
        self.guard = next(c for c in ("\n", "\t", "\0", "\x01") if not self.kind[ord(c)])
        self.guard_ids = len(sp.encode(self.guard))
        if any(self.encode(t)[0] != sp.encode(t, add_eos=True) for t in ("a merge, then another one.", "\n漢 x  y")):
            raise ValueError("the model is not of the merge type")
        self.known: dict[str, tuple[int, str, bytes, int]] = {}

    def _learn_cuts(self, pieces: list[str]) -> None:
        """``kind`` of each character (0: in no longer piece) and which kinds stand side by side in some piece."""
        letters = sorted(set("".join(pieces)))
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.kind[ord(" ")] = self.kind[ord(SPACE)]
        self.beside = np.zeros((len(letters) + 1,) * 2, bool)
        for p in pieces:
            k = self.kind[np.frombuffer(p.encode("utf-32-le"), np.uint32)]
            self.beside[k[:-1], k[1:]] = True

    def units(self, text: str) -> list[str]:
        """``text`` cut where no piece holds both neighbours; a space stands for the space mark."""
        kind = self.kind[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cut = (np.flatnonzero(~self.beside[kind[:-1], kind[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)])]

    def merge(self, unit: str) -> list[str]:
        """The symbols that the agenda leaves of ``unit``."""
        rank, sym, n = self.rank.get, list(unit.replace(" ", SPACE)), len(unit)
        if n <= SHORT:  # the agenda of a few symbols is a list: one entry per pair, the best is its leftmost minimum
            agenda = [rank(a + b, NEVER) for a, b in zip(sym, sym[1:])]
            while agenda and (best := min(agenda)) < NEVER:
                i = agenda.index(best)
                sym[i:i + 2] = [both := sym[i] + sym[i + 1]]
                del agenda[i]
                if i < len(agenda):
                    agenda[i] = rank(both + sym[i + 1], NEVER)
                if i:
                    agenda[i - 1] = rank(sym[i - 1] + both, NEVER)
            return sym
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [r * n + i for i in range(n - 1) if (r := rank(sym[i] + sym[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            r, i = divmod(heappop(agenda), n)
            j = after[i]
            if not sym[i] or j == n:
                continue
            both = sym[i] + sym[j]
            if rank(both) != r:
                continue
            sym[i], sym[j] = both, ""
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank(both + sym[k])) is not None:
                    heappush(agenda, r * n + i)
            if h >= 0 and (r := rank(sym[h] + both)) is not None:
                heappush(agenda, r * n + h)
        return [s for s in sym if s]

    def unit_ids(self, unit: str) -> list[int]:
        out = []
        for s in self.merge(unit):
            i = self.ids.get(s)
            out += [i] if i is not None else [self.byte[b] for b in s.encode()]
        return out

    def learn(self, units: list[str]) -> None:
        """Encode new ``units`` by the agenda, and by the library as a check."""
        if len(self.known) + len(units) > CACHE:
            self.known = {}
        for at in range(0, len(units), 4096):
            part = units[at:at + 4096]
            checks = self.library.encode([self.guard + u for u in part], num_threads=1)
            for u, check in zip(part, checks):
                ids, check = self.unit_ids(u), check[self.guard_ids:]
                self.known[u] = (len(check), " ".join(map(str, check)), b"".join([self.text[i] for i in check]), int(ids != check))

    def entries(self, units: list[str]) -> list[tuple[int, str, bytes, int]]:
        """``(number of ids, ids as text, decoded bytes, differs from the library)`` of each unit."""
        out = list(map(self.known.get, units))
        if None in out:
            new = list(dict.fromkeys(u for u, e in zip(units, out) if e is None))
            old = {u: e for u, e in zip(units, out) if e is not None} if len(self.known) + len(new) > CACHE else {}
            self.learn(new)
            out = [self.known.get(u) or old[u] for u in units]
        return out

    def blocks(self, text: str, units: list[str] | None = None) -> Iterator[list[tuple[int, str, bytes, int]]]:
        """Entries of a whole text, a block at a time; a unit that the end of a block cuts is carried on."""
        if units:
            yield self.entries(units)
            return
        rest = " "
        for at in range(0, len(text), BLOCK):
            units = self.units(rest + text[at:at + BLOCK].replace(SPACE, " "))
            last = at + BLOCK >= len(text)
            rest = "" if last else units.pop()
            if units:
                yield self.entries(units)

    def encode(self, text: str) -> tuple[list[int], str]:
        """``(ids with the end id, decoded text)`` without memory or check."""
        ids = [i for u in self.units(" " + text.replace(SPACE, " ")) for i in self.unit_ids(u)] if text else []
        return ids + [self.eos], b"".join(self.text[i] for i in ids).decode()[1:]

    def learn_all(self, texts: list[str]) -> list[list[str] | None]:
        """The units of short texts (None: empty or long), the new ones encoded with one call of the library."""
        units = [self.units(" " + t.replace(SPACE, " ")) if 0 < len(t) <= BLOCK else None for t in texts]
        new = set().union(*filter(None, units)).difference(self.known)
        if new:
            self.learn(list(new))
        return units

    def digests(self, text: str, units: list[str] | None = None) -> tuple[int, str, str, int]:
        """``(number of ids, digest of the ids, digest of the decoded text, units that differ)``."""
        ids, decoded = hashlib.sha256(), hashlib.sha256()
        n, differ, skip = 1, 0, 1  # the space mark in front of a text is not decoded
        for found in self.blocks(text, units):
            n += sum([e[0] for e in found])
            differ += sum([e[3] for e in found])
            ids.update(" ".join([e[1] for e in found]).encode() + b" ")
            decoded.update(b"".join([e[2] for e in found])[skip:])
            skip = 0
        ids.update(str(self.eos).encode())
        return n, ids.hexdigest(), decoded.hexdigest(), differ

    def texts(self, text: str, units: list[str] | None = None) -> tuple[str, str]:
        """``(ids, decoded text)``."""
        found = [e for block in self.blocks(text, units) for e in block]
        return " ".join([*(e[1] for e in found), str(self.eos)]), b"".join([e[2] for e in found])[1:].decode()


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(name: str) -> PieceEncoder:
    """The worker's encoder; the model file is found on the machine that runs the task."""
    if name not in _ENCODERS:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _ENCODERS[name] = PieceEncoder(path)
    return _ENCODERS[name]


def piece_bpe(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", full: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text as the ``sentencepiece`` library does with ``vocabulary`` (a name of the public set or a path
    that each machine has), an end id behind, no sampling, and decode the ids again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256, n_differ`` (units whose agenda result was not the
    library's, 0 expected); with ``full`` the ids (decimal, joined by a space) and the decoded text: ``doc_id, ids,
    decoded``. Null text counts as empty and encodes to the end id alone; null and repeated ids are kept, one row out
    per row in. Other columns are ignored; an empty table gives an empty result. Texts are read a block at a time and
    their digests grow with them, so a long text takes memory for its own characters only (and a single unit without
    a cut, such as one letter repeated, for its agenda).
    """
    schema = "doc_id long, ids string, decoded string" if full else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_differ long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary)
        one = enc.texts if full else enc.digests
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(1).to_pylist()
                out = [one(t, u) for t, u in zip(texts, enc.learn_all(texts))]
                cols = [part.column(0), *(pa.array(c) for c in zip(*out))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(["ids", "decoded"] if full else ["n_tokens", "ids_sha256", "decoded_sha256", "n_differ"])])

    return rows.mapInArrow(run, schema)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of the whole ``documents`` table with the public piece vocabulary."""
    return piece_bpe(documents(spark, sf_dir))
