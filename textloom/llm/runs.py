"""Periodic runs of words by a suffix automaton with link-cut access.

Words are appended to a suffix automaton one by one. Its suffix links form a tree that a link-cut tree (preferred
paths kept as splay trees) holds; a preferred path carries one colour, the last position at which its words ended.
Accessing the new prefix's state walks its suffixes from long to short, one preferred path at a time: a path of colour
``e`` whose deepest state on the way has length ``L`` says that the last ``L`` words, and no more, also ended at ``e``.
If the distance ``d = i - e`` is no greater than ``L``, the last ``2 * d`` words are a square of smallest period ``d``
whose run starts at ``i - L - d + 1``; it is extended to the right once and known from then on. The access then
recolours the whole way with ``i``.

A run of at least ``max(24, 3 * q)`` words with period ``q`` repeats each of its 8-word pieces inside itself, no
further away than ``q``. So only stretches whose 8-word pieces all recur within a third of the stretch go through the
automaton; no run can lie outside of them or reach over their ends, and prose costs a few NumPy calls per text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import documents
from textloom.llm.textbytes import mix

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Fewest words of a run, and fewest repetitions.
LEAST, TIMES = 24, 3
#: Words of a piece; 8 is the longest that every run of 24 words and three repetitions must repeat.
PIECE = 8

Run = tuple[int, int, int]


class Automaton:
    """Suffix automaton of the words appended so far and the link-cut tree over its suffix links.

    States have 32-bit entries in flat arrays; a state's first transition is kept there too, only states that branch
    have a dictionary.
    """

    def __init__(self):
        self.length, self.link, self.word, self.to = array("i", [0]), array("i", [-1]), array("i", [-1]), array("i", [-1])
        self.branch: dict[int, dict[int, int]] = {}
        # link-cut tree: children and parent in the splay tree (a splay root's parent is the state above its path),
        # and at splay roots the colour: where the path's words ended last
        self.left, self.right, self.up, self.end = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [-1])
        self.last = 0
        self.size = 0

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        for a in (self.word, self.to, self.left, self.right, self.end):
            a.append(-1)
        self.up.append(link)
        return len(self.length) - 1

    def _get(self, s: int, w: int) -> int:
        if self.word[s] == w:
            return self.to[s]
        more = self.branch.get(s)
        return more.get(w, -1) if more else -1

    def _set(self, s: int, w: int, t: int) -> None:
        if self.word[s] == w or self.word[s] < 0:
            self.word[s], self.to[s] = w, t
        else:
            self.branch.setdefault(s, {})[w] = t

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b >= 0:
            up[b] = y
        up[y], up[x] = x, z
        if z >= 0 and left[z] == y:
            left[z] = x
        elif z >= 0 and right[z] == y:
            right[z] = x
        else:
            self.end[x] = self.end[y]

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        while True:
            y = up[x]
            if y < 0 or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z >= 0:
                if left[z] == y:
                    self._rotate(y if left[y] == x else x)
                elif right[z] == y:
                    self._rotate(y if right[y] == x else x)
            self._rotate(x)

    def _clone(self, p: int, q: int, w: int) -> int:
        """A state for the shorter words of ``q``, put above it on its path with the same colour."""
        c = self._state(self.length[p] + 1, self.link[q])
        self.word[c], self.to[c] = self.word[q], self.to[q]
        if q in self.branch:
            self.branch[c] = dict(self.branch[q])
        while p >= 0 and self._get(p, w) == q:
            self._set(p, w, c)
            p = self.link[p]
        self.link[q] = c
        self._splay(q)
        above = self.left[q]
        self.up[c], self.left[c], self.right[c], self.end[c] = self.up[q], above, q, self.end[q]
        if above >= 0:
            self.up[above] = c
        self.left[q], self.up[q] = -1, c
        return c

    def append(self, w: int) -> list[tuple[int, int]]:
        """Append word ``w`` and recolour its suffixes: ``(distance, length)`` of the segments with a square, the
        distance to where the segment's words ended before being no greater than their greatest length."""
        i = self.size
        self.size += 1
        cur, p = self._state(i + 1, 0), self.last
        while p >= 0 and (q := self._get(p, w)) < 0:
            self._set(p, w, cur)
            p = self.link[p]
        if p >= 0:
            if self.length[p] + 1 != self.length[q]:
                q = self._clone(p, q, w)
            self.link[cur] = self.up[cur] = q
        self.last = cur
        squares = []
        x, below, end, right = cur, -1, self.end, self.right
        while x >= 0:
            self._splay(x)
            e, r = end[x], right[x]
            if r >= 0:
                end[r] = e
            right[x] = below
            if 0 <= i - e <= self.length[x] and e >= 0:
                squares.append((i - e, self.length[x]))
            below, x = x, self.up[x]
        end[below] = i
        return squares


def stretch_runs(words: list, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All ``(start, length, period)`` of maximal runs of at least ``least`` words and ``times`` (2 or more) periods."""
    code: dict = {}
    seq = [code.setdefault(w, len(code)) for w in words]
    n, out, known = len(seq), [], {}
    automaton = Automaton()
    for i, w in enumerate(seq):
        for d, common in automaton.append(w):
            if i < known.get(d, 0):
                continue
            e = i + 1
            while e < n and seq[e] == seq[e - d]:
                e += 1
            known[d] = e
            length = e - (i - common - d + 1)
            if length >= max(least, times * d):
                out.append((e - length, length, d))
    return out


def stretches(words: list[str]) -> list[tuple[int, int]]:
    """The parts of a text that can hold a run: every 8-word piece occurs again within a third of the part."""
    m = len(words) - PIECE + 1
    if len(words) < LEAST:
        return []
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for k in (1, 2, 4):
        h = mix(h[:len(h) - k]) + h[k:]
    order = np.argsort(h, kind="stable")
    near = np.full(m, m + PIECE, np.int64)
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    a, b = order[again], order[again + 1]
    np.minimum.at(near, a, b - a)
    np.minimum.at(near, b, b - a)
    ok = near <= len(words) // TIMES
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
        first, size = edge[::2], edge[1::2] - edge[::2] + PIECE - 1
        reach = np.zeros(m, np.int64)
        reach[ok] = np.repeat(np.where(size >= LEAST, size // TIMES, 0), edge[1::2] - first)
        still = ok & (near <= reach)
        if still.sum() == ok.sum():
            return list(zip(first.tolist(), (first + size).tolist()))
        ok = still


def runs(words: list[str]) -> list[Run]:
    """All maximal runs of a text, ``(start, length, period)`` ordered by start, then period."""
    out = [(a + s, n, q) for a, b in stretches(words) for s, n, q in stretch_runs(words[a:b])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(found: list[Run]) -> Run | None:
    """The run of the greatest length over period; ties go to the smallest start, then period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse(words: list[str], found: list[Run]) -> list[str]:
    """``words`` without those that some run contains after its first period."""
    if not found:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in found:
        drop[s + q] += 1
        drop[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def periodic_tail(doc_id: int | None, words: list[str]) -> list[str]:
    """The contract's edit: of one document in ten, chosen by its id, the words from a place on repeat a short period."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def periodic_runs(docs: DataFrame, edit: bool = False, full: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of words in every text: stretches of at least ``max(24, 3 * period)`` consecutive words in which words a
    period apart are equal, that no neighbouring word extends. Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.

    Returns ``doc_id, n_runs, start, length, period, exponent_milli`` of the strongest run (null without a run) and
    ``runs_sha256, collapsed_sha256``; with ``full`` the lists themselves: ``doc_id, runs`` (array of start, length,
    period) and ``collapsed``, the text without repeated periods. With ``edit`` one document in ten is first given a
    periodic tail (``periodic_tail``). Null and empty texts have no words and no runs; null and repeated ids are kept
    (a null id is never edited), one row out per row in. Other columns are ignored; an empty table gives an empty
    result. A text's work stays in one task; its memory is about 150 bytes per word of the stretch at hand.
    """
    schema = ("doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string" if full else
              "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    types = [pa.int64(), run_type, pa.string()] if full else [pa.int64()] * 6 + [pa.string()] * 2
    names = [f.split()[0] for f in (("doc_id", "runs", "collapsed") if full else schema.split(", "))]

    def one(doc_id, text: str) -> tuple:
        words = _WORD.findall(text)
        if edit:
            words = periodic_tail(doc_id, words)
        found = runs(words)
        collapsed = " ".join(collapse(words, found))
        if full:
            return doc_id, [dict(zip(("start", "length", "period"), r)) for r in found], collapsed
        best = strongest(found)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return doc_id, len(found), *top, _sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), _sha(collapsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = [one(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the whole ``documents`` table, one document in ten with a periodic tail."""
    return periodic_runs(documents(spark, sf_dir), edit=True)
