"""Vectorised byte-level helpers shared by the operators: words, lines and their 64-bit hashes.

Everything works on the UTF-8 buffer of a whole Arrow batch, so a batch costs a fixed number of NumPy calls
and no Python work per word. ``slices`` keeps the working set bounded: the arrays derived from a slice are a
small multiple of ``max_bytes`` (one text that is larger than that forms a slice of its own).
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa

#: White space of the word pattern ``[^\x20\x09-\x0D]+`` (all ASCII, so bytes decide).
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15 | 1)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: One random 64-bit value per byte: the digits of the polynomial hash.
_DIGIT = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every output bit depends on every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n-1)`` modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    if n > 1:
        out[1] = base
    k = 2
    while k < n:
        m = min(k, n - k)
        out[k:k + m] = out[:m] * (out[k - 1:k] * base)
        k += m
    return out[:max(n, 0)]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``max_bytes`` bytes each, or of one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + max_bytes, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def _runs(inside: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of ``inside``, none of which crosses a position of ``starts_at``."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = starts_at[(starts_at > 0) & (starts_at < n)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial hash from prefix sums, then finalised with its length."""
    n = len(raw)
    acc = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_DIGIT[raw] * powers(_P, n), dtype=np.uint64, out=acc[1:])
    h = (acc[end] - acc[start]) * powers(_P_INV, n + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Words of the rows: ``(start, end, hash, first)``; ``first[i]:first[i+1]`` are the words of row ``i``."""
    if lower:
        raw = LOWER[raw]
    s, e = _runs(~_SPACE[raw], offsets[:-1])
    return s, e, span_hash(raw, s, e), np.searchsorted(s, offsets)


def lines(raw: np.ndarray, offsets: np.ndarray):
    """Lines (split at ``\\n``) of the rows: ``(start, end, first)``; an empty text has one empty line."""
    n = len(offsets) - 1
    nl = np.flatnonzero(raw == 10)
    s = np.concatenate([offsets[:-1], nl + 1])
    row = np.concatenate([np.arange(n), np.searchsorted(offsets, nl, side="right") - 1])
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    first = np.searchsorted(row, np.arange(n + 1))
    nxt = np.empty(len(s), np.int64)
    nxt[:-1] = s[1:] - 1
    if len(s):
        nxt[-1] = offsets[-1]
    nxt[first[1:] - 1] = offsets[1:]
    return s, nxt, first


def shingles(word_hash: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of the distinct ``k``-word shingles per row, ordered by row, then hash.

    A row with one to ``k - 1`` words has its whole sequence as its only shingle; a row without words has none.
    """
    n_rows, count = len(first) - 1, np.diff(first)
    n = len(word_hash)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hash * np.uint64(0xA0761D6478BD642F)
    acc = h.copy()
    for j in range(1, k):
        acc[:n - j] = mix(acc[:n - j]) + h[j:]
    row = np.repeat(np.arange(n_rows), count)
    pos = np.arange(n) - first[row]
    keep = pos + k <= count[row]
    rows, hs = row[keep], mix(acc[keep])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        sh = []
        for r in short:
            v = h[first[r]:first[r] + 1].copy()
            for j in range(1, count[r]):
                v = mix(v) + h[first[r] + j]
            sh.append(mix(v + np.uint64(count[r]))[0])
        rows = np.concatenate([rows, short])
        hs = np.concatenate([hs, np.array(sh, dtype=np.uint64)])
    order = np.lexsort((hs, rows))
    rows, hs = rows[order], hs[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hs[1:] != hs[:-1])
    return rows[new], hs[new]
