"""Secret scans with dictionary-primed zstandard novelty.

Base spans come from three fixed patterns. Further candidates are strings behind a word that announces something
sensitive: its value (``NAME=value``, ``name: "value"``, the line below its name, the body of a PEM block) from
``LEAST`` characters on, whatever it is made of; elsewhere behind it on its line, strings of ``LONG`` characters or
more, and within ``NEAR`` characters those of letters and digits from ``LEAST`` on. Each candidate is measured by its marginal compressed bytes: the text around it is compressed with a
dictionary of common code and of the identifiers of its document, once with and once without the candidate. A
candidate that costs nearly as much as random characters would is reported; words, paths and names that the
dictionary or the surroundings predict are not.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import documents, per_batch

KINDS = ("assign", "access", "hex", "novel")

#: Characters on each side of a candidate that count as its surroundings.
AROUND = 2048
#: Most bytes of identifiers in one dictionary; a document with more has several.
PRIMED = 1 << 16
#: Least marginal compressed bytes per character: random hex costs about 0.5, random base64 0.75.
MIN_NOVELTY = 0.45

#: Least characters of a value (as in the base pattern) and of other strings, and how far behind the word shorter ones may stand.
LEAST, LONG, NEAR = 6, 16, 48

# The base patterns, and code that primes the dictionary.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_SENSITIVE = re.compile(r"(?ai)(?:pass(?:word|phrase|wd)?|pwd|secret|token|key|auth|bearer|credential|private|signature|cookie|session)")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
# a "=" inside a string that has a value behind it; a sensitive name that leads a string; a run of letters or digits only
_PARTS = re.compile(r"=+(?=[A-Za-z0-9+/_-])")
_LEADING = re.compile(rf"(?ai).*{_SENSITIVE.pattern[5:]}[a-z]{{0,3}}[_/-]+")
_RUN = re.compile(r"[A-Za-z]{16,}|[0-9]{16,}")
# what may stand between a sensitive word and its value ("author" is none), and at the end of a line whose value is on the next
_VALUE = re.compile(r"""(?ai)(?!(?<=auth)or(?!iz))[a-z0-9_.-]*["'`)\]\x20\t]*(?:=>|:=|==|[:=>])[\x20\t"'`(\[]*(?:(?:bearer|basic|token)\x20+)?""")
_OPEN = re.compile(r"""(?ai)(?:[:=>|\\({\["'`]|(?:pass(?:word|phrase|wd)?|pwd|secret|token|key|auth|bearer|credential|private|signature|cookie|session)s?)\s*\Z""")
_CODE = (
    "import from return def class self None True False function const let var public private static void string int "
    "if else for while try except catch finally throw new this null undefined export default async await require "
    "http https www com org net example localhost index main config settings username password secret token apikey "
    "api_key access_key private_key client_id client_secret authorization bearer basic cookie session credential "
    "database host port user name value path file directory environment production development version license "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef"
).encode()
_IDENTIFIER = re.compile(r"[A-Za-z0-9_]{3,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the three patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of at least 24 such characters is found whole, so this drops exactly the shorter runs
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _strings(line: str) -> list[tuple[int, int]]:
    """Strings of a line, parted at a ``=`` that has a value behind it."""
    out = []
    for m in _CANDIDATE.finditer(line):
        a = m.start()
        for cut in _PARTS.finditer(line, a, m.end()):
            out.append((a, cut.start()))
            a = cut.end()
        out.append((a, m.end()))
    return [(a, b) for a, b in out if b - a >= LEAST]


def _is_candidate(line: str, a: int, b: int, ends: list[int]) -> bool:
    """Whether a string with sensitive words that end at ``ends`` before it is measured."""
    if any(a - e <= 2 * NEAR and _VALUE.fullmatch(line, e, a) for e in ends):
        return True
    word = line[a:b]
    mixed = any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
    return mixed and (len(word) >= LONG or a - ends[-1] <= NEAR) or bool(_RUN.search(word))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Strings behind a sensitive word, apart from base spans."""
    if not _SENSITIVE.search(text):
        return []
    out = []
    at, opened, block = 0, False, False
    for line in text.split("\n"):
        ends = [m.end() for m in _SENSITIVE.finditer(line)]
        begins, closes = "-----BEGIN" in line, "-----END" in line
        if ends or opened or block:
            for a, b in _strings(line):
                before = ends[:bisect_right(ends, a)]
                ok = (block and not closes) or opened or bool(before) and _is_candidate(line, a, b, before)
                if not ok and not before and (m := _LEADING.match(line, a, b)) and b - m.end() >= LEAST:
                    word = line[m.end():b]
                    ok = any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
                    a = m.end()
                opened = False
                if ok and not (begins or closes) and not any(s < at + b and at + a < e for s, _, e in taken):
                    out.append((at + a, at + b))
        if begins or closes:
            block = begins and bool(ends) and not closes
        if line.strip():
            opened = bool(ends) and not block and bool(_OPEN.search(line))
        at += len(line) + 1
    return out


def novelty(text: str, spans: list[tuple[int, int]]) -> list[float]:
    """Marginal compressed bytes per character of each span, given its surroundings and the dictionary that knows it best."""
    import zstandard

    # identifiers of the text outside the spans themselves, all of them
    seen, at = {}, 0
    for a, b in [*sorted(spans), (len(text), len(text))]:
        seen.update(dict.fromkeys(_IDENTIFIER.findall(text, at, max(at, a))))
        at = max(at, b)
    parts, size = [[]], 0
    for name in seen:
        if size and size + len(name) >= PRIMED:
            parts.append([])
            size = 0
        parts[-1].append(name)
        size += len(name) + 1
    out = [float("inf")] * len(spans)
    for names in parts:
        primed = zstandard.ZstdCompressionDict(" ".join(names).encode() + b" " + _CODE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        for i, (a, b) in enumerate(spans):
            before, after = text[max(0, a - AROUND):a].encode(), text[b:b + AROUND].encode()
            around = len(packer.compress(before + after))
            cost = (len(packer.compress(before + text[a:b].encode() + after)) - around) / max(1, b - a)
            out[i] = min(out[i], cost)
    return out


def scan(text: str) -> list[tuple[int, int, int, float]]:
    """``(start, kind number, end, novelty)`` of all secrets of a text: base spans and novel strings."""
    base = base_spans(text)
    more = candidates(text, base)
    if not base and not more:
        return []
    cost = novelty(text, [(s, e) for s, _, e in base] + more)
    found = [(*b, c) for b, c in zip(base, cost)]
    found += [(a, 3, b, c) for (a, b), c in zip(more, cost[len(base):]) if c >= MIN_NOVELTY]
    return sorted(found)


_SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int,novelty:double>>"
_SPANS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())])))])


def _scan_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids, texts = batch.column(0), batch.column(1)
    for at in range(0, batch.num_rows, 500):
        part = texts.slice(at, 500)
        found = [[{"kind": KINDS[k], "start": s, "end": e, "novelty": c} for s, k, e, c in scan(t.as_py() or "")] for t in part]
        yield pa.RecordBatch.from_arrays([ids.slice(at, 500), pa.array(found, _SPANS_SCHEMA.field(1).type)], schema=_SPANS_SCHEMA)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` per row: the spans of all secrets, by start and kind, in code points with exclusive ends.

    Kinds ``assign``, ``access`` and ``hex`` are the base patterns and always reported, with their novelty; ``novel``
    are further strings in a sensitive context whose novelty reaches ``MIN_NOVELTY``. Null text counts as empty and
    has no spans; null and repeated ids are kept, one row out per row in. Other columns are ignored. Each row is
    scanned where it is read: there is no shuffle, and memory is bounded by a batch and its longest text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(per_batch(_scan_batch), _SPANS)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of the whole ``documents`` table: counts per base kind, digest of the base spans and all spans."""
    found = secrets(documents(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def text(keep):
        line = F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(line, ",")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(lambda s: s["kind"] != "novel"), 256).alias("base_sha256"), text(lambda s: F.lit(True)).alias("spans"),
        count("novel").alias("n_novel"))
