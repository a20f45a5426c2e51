"""Span, tag and alignment operators.

All alignment work happens inside one row, so no operator here shuffles or
pairs tokens with spans.  A dense ``char -> token`` array is built by
concatenating one segment per token; tags are painted span by span in an
Arrow batch (``paint``), linear in tokens plus tagged cells.  Operators that
fan out (windows, mentions) build a row's whole output in an Arrow batch from
the tokenizer's batch form and explode it last.

Spans of a row may nest or cross: they are painted in list order, so where two
touch the same token or character the later one of the list wins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.batches import fan_out, groups, stepwise
from textloom.functions.hof import bind_column, let, let_many, shift_left, shift_right
from textloom.functions.tokens import HashVocab


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit_array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ---------------------------------------------------------------- N1

def tags_to_names(ids, names: list[str]) -> Column:
    """Array of tag ids → array of tag names."""
    arr = _lit_array(names)
    return F.transform(_c(ids), lambda i: F.get(arr, i))


def tag_id(name: Column, tag_list: list[str]) -> Column:
    """Index of a tag name in ``tag_list`` (0-based)."""
    return (F.array_position(_lit_array(tag_list), name) - 1).cast("int")


# ---------------------------------------------------------------- N2 / N3

def _joined(values: pa.Array, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The strings ``values[first:last]`` of each pair of bounds, joined without a separator."""
    values = pc.fill_null(values, "").cast(pa.large_string())
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = off[last] - off[first]
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(bounds[-1]) + np.repeat(off[first] - bounds[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(raw[at])]).cast(pa.string())


def _sizes(a: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False), dtype=np.int64)


def spans_of_tags(chars: pa.Array, tags: pa.Array, compat: bool = False) -> pa.Array:
    """N2 over a whole batch: lists of ``{form, begin, end, label}``; see ``char_tags_to_spans``."""
    size = _sizes(tags)
    row_end = np.cumsum(size)
    coded = pc.dictionary_encode(pc.fill_null(tags.flatten(), "I"))
    names = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    opens, goes_on = (np.array([n.startswith(c) for n in names], bool) for c in "BI")
    breaks = np.flatnonzero(~goes_on[code]) if len(names) else np.zeros(0, np.int64)
    row = np.searchsorted(row_end, breaks, side="right")
    # a span ends at the next break of its row, or with the row
    end = np.minimum(np.append(breaks[1:], row_end[-1] if len(row_end) else 0), row_end[row]) if len(breaks) else breaks
    keep = opens[code[breaks]] & ((end < row_end[row]) if compat else True) if len(breaks) else np.zeros(0, bool)
    at, end, row = breaks[keep], end[keep], row[keep]
    begin, stop = at - (row_end - size)[row], end - (row_end - size)[row]
    char_end = np.cumsum(_sizes(chars))
    char_row = (char_end - _sizes(chars))[row]
    form = _joined(chars.flatten(), np.minimum(char_row + begin, char_end[row]), np.minimum(char_row + stop, char_end[row]))
    labels = np.array([n.rsplit("-", 1)[-1] for n in names], object)
    spans = pa.StructArray.from_arrays([form, pa.array(begin, pa.int32()), pa.array(stop, pa.int32()), pa.array(labels[code[at]] if len(at) else [], pa.string())],
                                       names=["form", "begin", "end", "label"])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))])
    null = pc.or_(chars.is_null(), tags.is_null())
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans, mask=null if pc.any(null).as_py() else None)


def char_tags_to_spans(chars, tags, compat: bool = False) -> Column:
    """IOB tag names per character → ``ARRAY<STRUCT<form, begin, end, label>>``.

    ``B`` opens a span (closing an open one), ``I`` extends it, anything else
    closes it; an ``I`` with no open span is ignored.  ``end`` is exclusive.
    ``compat=True`` drops a span still open at the end of the text, as the
    reference does.  One pass over the characters of a few rows of an Arrow batch at a time.
    """
    def run(c: pa.Array, t: pa.Array) -> pa.Array:
        return stepwise(lambda *x: spans_of_tags(*x, compat), c, t)

    return F.arrow_udf(run, "array<struct<form:string,begin:int,end:int,label:string>>")(_c(chars), _c(tags))


def char_example(df: DataFrame, chars: str = "tokens", tag_ids: str = "ner_tags",
                 names: list[str] | None = None, compat: bool = False) -> DataFrame:
    """Character list + tag ids → ``text`` and spans ``NE``."""
    from textloom.labels import CHAR_NER_IOB2

    names = names or CHAR_NER_IOB2
    spans = char_tags_to_spans(F.col(chars), tags_to_names(F.col(tag_ids), names), compat=compat)
    # bound once: an explode of the spans would otherwise evaluate them again for its filter
    return bind_column(df.withColumn("text", F.array_join(F.col(chars), "")).drop("NE"), "NE", spans)


# ---------------------------------------------------------------- N4

def char_to_token(tokens, text_len) -> Column:
    """For every character position the index of the token holding it, or NULL.

    ``tokens``: ``ARRAY<STRUCT<start, end>>`` sorted and non-overlapping.
    Built as one segment per token (nulls for the gap, then the index
    repeated), each token paired with the previous token's end: linear.
    """
    null_int = F.lit(None).cast("int")

    def body(tk):
        prev_end = shift_right(F.transform(tk, lambda t: t["end"]), 0)
        segs = F.transform(F.arrays_zip(tk.alias("t"), prev_end.alias("pe")), lambda z, i: F.concat(
            F.array_repeat(null_int, F.greatest(z["t"]["start"] - z["pe"], F.lit(0))),
            F.array_repeat(i, F.greatest(z["t"]["end"] - z["t"]["start"], F.lit(0)))))
        body_ = F.flatten(segs)
        return F.concat(F.slice(body_, 1, _c(text_len)),
                        F.array_repeat(null_int, F.greatest(_c(text_len) - F.size(body_), F.lit(0))))

    return let(_c(tokens), body)


def _flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row bounds of a list column; a null list is empty, a null value is -1."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    values = pc.fill_null(a.flatten(), -1).to_numpy(zero_copy_only=False)
    return values.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def paint(cell_start: pa.Array, cell_end: pa.Array, begin: pa.Array, end: pa.Array, first: pa.Array, rest: pa.Array,
          outside: int) -> pa.Array:
    """Tag of every cell (token or character): ``first`` of a span on the first cell it touches, ``rest`` on the
    others, ``outside`` elsewhere; the spans of a row are painted in list order.

    Cells of a row are sorted and do not overlap.  Rows are laid behind each other on one axis, so the cells of
    all spans of a batch come from two binary searches, and one assignment in list order paints them.
    """
    cs, rows = _flat(cell_start)
    ce, _ = _flat(cell_end)
    b, span_rows = _flat(begin)
    e, _ = _flat(end)
    vb, vi = _flat(first)[0], _flat(rest)[0]
    width = int(max([0, *(int(x.max()) for x in (ce, e, b) if len(x))])) + 2
    axis = np.repeat(np.arange(len(rows) - 1), np.diff(rows)) * width
    span_axis = np.repeat(np.arange(len(span_rows) - 1), np.diff(span_rows)) * width
    b = np.maximum(b, 0)
    lo = np.searchsorted(ce + axis, b + span_axis, side="right")
    hi = np.searchsorted(cs + axis, e + span_axis, side="left")
    n = np.where(e > b, np.maximum(hi - lo, 0), 0)
    which = np.repeat(np.arange(len(b)), n)
    place = np.arange(len(which)) - (np.cumsum(n) - n)[which]
    out = np.full(len(cs), outside, dtype=np.int32)
    out[lo[which] + place] = np.where(place == 0, vb[which], vi[which])  # of repeated cells the last value stays
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(out), mask=cell_start.is_null() if cell_start.null_count else None)


def _painted(cell_start: Column, cell_end: Column, spans: Column, b_tag, i_tag, outside: int) -> Column:
    def run(cs: pa.Array, ce: pa.Array, b: pa.Array, e: pa.Array, vb: pa.Array, vi: pa.Array) -> pa.Array:
        return stepwise(lambda *x: paint(*x, outside), cs, ce, b, e, vb, vi)

    return F.arrow_udf(run, "array<int>")(
        cell_start, cell_end, F.transform(spans, lambda s: s["begin"].cast("int")), F.transform(spans, lambda s: s["end"].cast("int")),
        F.transform(spans, b_tag), F.transform(spans, i_tag))


def token_tags(tokens, spans, b_tag, i_tag, outside: int) -> Column:
    """Core of N6/N7/N10/N12: tag id per token.

    ``spans``: ``ARRAY<STRUCT<begin, end, ...>>`` (end exclusive) already
    filtered to the spans that tag; ``b_tag(span)`` / ``i_tag(span)`` give the
    ids.  A token is tagged by the last span of the list that covers any of
    its characters; it is ``B`` when it is that span's first token.
    """
    tk = _c(tokens)
    return _painted(F.transform(tk, lambda t: t["start"].cast("int")), F.transform(tk, lambda t: t["end"].cast("int")), _c(spans),
                    b_tag, i_tag, outside)


def _label_tags(tag_list: list[str]):
    tags = _lit_array(tag_list)

    def at(prefix: str):
        return lambda s: (F.array_position(tags, F.concat(F.lit(prefix), s.getField("label"))) - 1).cast("int")

    return at("B-"), at("I-"), tag_list.index("O")


def spans_to_token_tags(tokens, spans, tag_list: list[str]) -> Column:
    """Spans ``{form, begin, end, label name}`` → IOB2 tag ids per token; label ``O`` is skipped."""
    return token_tags(tokens, F.filter(_c(spans), lambda s: s.getField("label") != F.lit("O")), *_label_tags(tag_list))


def parallel_spans(ne, type_names: list[str]) -> Column:
    """N7 input: ``STRUCT<begin[], end[], label[] ids>`` → span structs with label names."""
    types = _lit_array(type_names)
    z = F.arrays_zip(_c(ne).getField("begin").alias("begin"), _c(ne).getField("end").alias("end"),
                     _c(ne).getField("label").alias("label"))
    return F.transform(z, lambda s: F.struct(
        s.getField("begin").alias("begin"), s.getField("end").alias("end"),
        F.get(types, s.getField("label")).alias("label")))


def spans_to_char_tags(spans, text_len, tag_list: list[str]) -> Column:
    """All ``O``, then ``B-x`` on a span's first char and ``I-x`` on the rest (tag ids)."""
    n = _c(text_len)
    start = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).cast("array<int>")
    kept = F.filter(_c(spans), lambda s: s["label"] != F.lit("O"))
    return _painted(start, F.transform(start, lambda p: p + 1), kept, *_label_tags(tag_list))


# ---------------------------------------------------------------- N8

def entity_token_bounds(tokens, text_len, entities: list[Column], end_inclusive: bool = True) -> Column:
    """``[[first, last], …]`` token index per entity; NULL pair when it has no token."""
    def body(c2t):
        out = []
        for e in entities:
            start = e.getField("start_idx")
            stop = e.getField("end_idx") + (1 if end_inclusive else 0)
            seg = F.slice(c2t, start + 1, F.greatest(stop - start, F.lit(0)))
            lo, hi = F.array_min(seg), F.array_max(seg)  # both skip NULLs; NULL when no token
            out.append(F.when(lo.isNotNull(), F.array(lo, hi)))
        return F.array(*out)

    return let(char_to_token(tokens, text_len), body)


# ---------------------------------------------------------------- N9

def _structs(rows: list, names: list[str], types: list, ready: dict | None = None) -> pa.Array:
    """Lists of structs from a list (or None) of tuples per row; ``ready`` adds fields that are columns already."""
    flat = [x for r in rows if r for x in r]
    cols = list(zip(*flat)) if flat else [()] * len(names)
    ready = ready or {}
    items = pa.StructArray.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), *ready.values()], names=[*names, *ready])
    bounds = np.concatenate([[0], np.cumsum([len(r) if r else 0 for r in rows])])
    null = pa.array([r is None for r in rows])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items, mask=null if pc.any(null).as_py() else None)


def _lists(a: pa.Array, of=None) -> list:
    """A list column as Python lists; ``of`` converts the values of the innermost lists' array (default: integers).

    ``to_pylist`` of nested lists makes an object per value; this slices one flat list per level.
    """
    values = a.flatten()
    if pa.types.is_list(values.type):
        values = _lists(values, of)
    else:
        values = of(values) if of else pc.fill_null(values, 0).to_numpy(zero_copy_only=False).tolist()
    out, at = [], 0
    for n in _sizes(a).tolist():
        out.append(values[at:at + n])
        at += n
    return out


def _mentions(chains: pa.Array) -> list[list[tuple]]:
    """Per row its mentions ``(begin, end, chain, place in the chain, form)``, ordered by begin."""
    lists = chains.flatten()[[f.name for f in chains.type].index("mention")]
    fields = dict(zip([f.name for f in lists.type.value_type], lists.flatten().flatten()))
    begin, end, form = _lists(fields["begin"]), _lists(fields["end"]), _lists(fields["form"], pa.Array.to_pylist)
    out, at = [], 0
    for n in _sizes(lists).tolist():
        out.append(sorted(((b, e, c, j, f) for c in range(n) for j, (b, e, f) in enumerate(zip(begin[at + c], end[at + c], form[at + c]))),
                          key=lambda x: x[:4]))
        at += n
    return out


def _chains(cut: list[list[tuple]]) -> pa.Array:
    """Struct column ``{mention, chain}`` from the chains ``(number, begins, ends, forms)`` of each window."""
    flat = [c for chains in cut for c in chains]
    ints = pa.list_(pa.int32())
    mentions = pa.StructArray.from_arrays([pa.array([c[1] for c in flat], ints), pa.array([c[2] for c in flat], ints),
                                           pa.array([c[3] for c in flat], pa.list_(pa.string()))], names=["begin", "end", "form"])
    bounds = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in cut])]), pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(bounds, mentions), pa.array([[x[0] for x in c] for c in cut], ints)], names=["mention", "chain"])


_CHAINS_DDL = "struct<mention:array<struct<begin:array<int>,end:array<int>,form:array<string>>>,chain:array<int>>"


def _cut_chains(mentions: list, begins: list, lo: int, hi: int) -> list[tuple]:
    """The chains with a mention inside ``[lo, hi]``: ``(number, begins, ends, forms)``; mentions keep their order."""
    found: dict = {}
    for b, e, c, j, form in mentions[bisect_left(begins, lo):bisect_right(begins, hi)]:
        if e <= hi:
            found.setdefault(c, []).append((j, b, e, form))
    out = []
    for c in sorted(found):
        _, bs, es, forms = zip(*sorted(found[c]))
        out.append((c, bs, es, forms))
    return out


def doc_windows(df: DataFrame, id_col: str, text_col: str, tokenizer=None, span_length: int = 448,
                doc_stride: int = 128, chains_col: str | None = None) -> DataFrame:
    """Sliding token windows over each document.

    Windows of at most ``span_length`` tokens start every ``min(span_length,
    doc_stride)`` tokens and stop at the first window that reaches the end.
    Closed form ``k = ceil((n - L) / step)`` for ``n > L``; the fan-out is an
    ``explode`` inside the partition (no shuffle) of a list that an Arrow batch
    cuts from the text once, by token offsets.  Output adds ``id``
    (``"{id}:{k}"``), ``span_ch_start``, ``span_ch_end``; ``text_col`` is cut
    to the window; other columns are copied.  With ``chains_col`` a window gets
    only the mentions inside it instead of a copy of all chains of the document;
    the numbers of the chains they belong to stand in the field ``chain``.
    """
    tok = tokenizer or HashVocab()
    step = min(span_length, doc_stride)

    def cut(texts: pa.Array, chains: pa.Array | None) -> pa.Array:
        rows, found = [], []
        mentions = _mentions(chains) if chains is not None else None
        for row, text in enumerate(texts.to_pylist()):
            at = tok.offsets(text) if text is not None else []
            n, out = len(at), []
            begins = [m[0] for m in mentions[row]] if mentions else None
            for w in range(0 if not n else 1 if n <= span_length else 1 + -((span_length - n) // step)):
                s, e = at[w * step][0], at[min(w * step + span_length, n) - 1][1]
                out.append((w, s, e, text[s:e]))
                if mentions:
                    found.append(_cut_chains(mentions[row], begins, s, e))
            rows.append(out)
        return _structs(rows, ["w", "s", "e", "t"], [pa.int32(), pa.int32(), pa.int32(), pa.string()],
                        {"cr": _chains(found)} if chains is not None else {})

    def plain(texts: pa.Array) -> pa.Array:
        return cut(texts, None)

    def chained(texts: pa.Array, chains: pa.Array) -> pa.Array:
        return cut(texts, chains)

    fields = "w:int,s:int,e:int,t:string"
    wins = fan_out(plain, f"array<struct<{fields}>>", F.col(text_col)) if chains_col is None else \
        fan_out(chained, f"array<struct<{fields},cr:{_CHAINS_DDL}>>", F.col(text_col), F.col(chains_col))
    # bound before the explode, so that its filter on the size reads the list and does not cut it again
    t = bind_column(df, "_wins", wins)
    t = t.select(*[c for c in df.columns if c not in (text_col, chains_col)], F.explode("_wins").alias("_win"))
    new = {
        "span_ch_start": F.col("_win.s"),
        "span_ch_end": F.col("_win.e"),
        "id": F.concat_ws(":", F.col(id_col).cast("string"), F.col("_win.w").cast("string")),
        text_col: F.col("_win.t"),
    }
    if chains_col is not None:
        new[chains_col] = F.col("_win.cr")
    names = [*df.columns, *[c for c in ("span_ch_start", "span_ch_end", "id") if c not in df.columns]]
    return t.withColumns(new).select(*names)


# ---------------------------------------------------------------- N10-N13

def _bio(starts: list, ends: list, spans) -> list[int]:
    """``O/B/I`` (0/1/2) per token, the spans painted in list order."""
    out = [0] * len(starts)
    for b, e in spans:
        b = max(b, 0)
        lo, hi = bisect_right(ends, b), bisect_left(starts, e)
        if e > b and hi > lo:
            out[lo:hi] = [1] + [2] * (hi - lo - 1)
    return out


def _window(df: DataFrame, text_col: str, cr_col: str) -> list[Column]:
    """What an Arrow batch needs of a row: text, window start and end, begins and ends per chain, chain numbers."""
    chains = F.col(cr_col).getField("mention")
    lo = F.col("span_ch_start") if "span_ch_start" in df.columns else F.lit(0)
    hi = F.col("span_ch_end") if "span_ch_end" in df.columns else F.length(text_col)
    numbered = any(f.name == "chain" for f in df.schema[cr_col].dataType.fields)
    number = F.col(cr_col).getField("chain") if numbered else F.transform(chains, lambda m, i: i)
    return [F.col(text_col), lo.cast("int"), hi.cast("int"), F.transform(chains, lambda m: m.getField("begin").cast("array<int>")),
            F.transform(chains, lambda m: m.getField("end").cast("array<int>")), number.cast("array<int>")]


def _inside_window(lo: int, hi: int, begins: list, ends: list, compat: bool) -> list:
    """``(begin, end)`` of a chain's mentions inside the window, moved to its start."""
    if compat:
        return [(b - lo, e - lo) for b, e in zip(begins, ends) if lo < b and e < hi]
    return [(b - lo, e - lo) for b, e in zip(begins, ends) if lo <= b and e <= hi]


def mention_tags(df: DataFrame, text_col: str, cr_col: str = "CR", tokenizer=None, compat: bool = False,
                 out_col: str = "targets") -> DataFrame:
    """``O/B/I`` (0/1/2) per token for every mention inside the row's window.

    Works on plain rows (window = whole text) and on ``doc_windows`` output
    (uses ``span_ch_start``/``span_ch_end``).  ``compat`` keeps the reference's
    strict bounds, which drop mentions touching a window edge.
    """
    tok = tokenizer or HashVocab()

    def run(texts: pa.Array, lo: pa.Array, hi: pa.Array, begins: pa.Array, ends: pa.Array, numbers: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        rows = []
        for text, tokens, l, h, bs, es in zip(texts, tok.batch([t or "" for t in texts]), lo.to_pylist(), hi.to_pylist(), _lists(begins), _lists(ends)):
            spans = [m for b, e in zip(bs, es) for m in _inside_window(l, h, b, e, compat)] if text is not None else []
            rows.append([([t[1] for t in tokens], _bio([t[2] for t in tokens], [t[3] for t in tokens], spans)) if text is not None else (None, None)])
        return _structs(rows, ["ids", "targets"], [pa.list_(pa.int32())] * 2)

    tagged = fan_out(run, "array<struct<ids:array<int>,targets:array<int>>>", *_window(df, text_col, cr_col))
    bound = bind_column(df.withColumn(f"{text_col}_pretokenized", F.col(text_col)), "_tagged", tagged)
    return bound.withColumns({text_col: F.get("_tagged", 0)["ids"], out_col: F.get("_tagged", 0)["targets"]}).drop("_tagged")


def shift_position(p: Column, tb: Column, te: Column) -> Column:
    """Position after marks are inserted before ``tb`` and before ``te`` (N11, fixed form)."""
    return p + F.when(p > tb, 1).otherwise(0) + F.when(p >= te, 1).otherwise(0)


def mark_mention(text: Column, target: Column, cands: Column, mark: str = "*", compat: bool = False):
    """Mark the target on both sides; move candidate spans to the marked text."""
    tb, te = target.getField("begin"), target.getField("end")
    marked = F.concat(F.substring(text, F.lit(1), tb), F.lit(mark), F.substring(text, tb + 1, te - tb),
                      F.lit(mark), F.substring(text, te + 1, F.length(text) + 1))
    if compat:
        moved = F.transform(cands, lambda c: F.when(
            c.getField("begin") > te, F.struct((c.getField("begin") + 2).alias("begin"), (c.getField("end") + 2).alias("end"),
                                               c.getField("form").alias("form"))
        ).when(c.getField("end") == te, F.struct(c.getField("begin").alias("begin"), (c.getField("end") + 2).alias("end"),
                                                 c.getField("form").alias("form"))
               ).otherwise(F.struct(c.getField("begin").alias("begin"), c.getField("end").alias("end"),
                                    c.getField("form").alias("form"))))
    else:
        moved = F.transform(cands, lambda c: F.struct(
            shift_position(c.getField("begin"), tb, te).alias("begin"),
            shift_position(c.getField("end"), tb, te).alias("end"),
            c.getField("form").alias("form")))
    return marked, moved


def _surfaces(tokens: list, starts: list, ends: list, spans) -> list[str]:
    """N12 surface text: words of the tokens each span covers, joined by a space; spans by begin."""
    out = []
    for b, e in sorted(spans, key=lambda x: x[0]):
        lo, hi = bisect_right(ends, b), bisect_left(starts, e)
        out.append(" ".join(t[0] for t in tokens[lo:hi]) if e > b else "")
    return out


def _moved(spans: list, tb: int, te: int, compat: bool) -> list:
    """Spans of a window moved to the text in which ``[tb, te)`` is marked on both sides."""
    if compat:
        return [(b + 2, e + 2) if b > te else (b, e + 2) if e == te else (b, e) for b, e in spans]
    return [(b + (b > tb) + (b >= te), e + (e > tb) + (e >= te)) for b, e in spans]


def mention_augment(df: DataFrame, id_col: str, text_col: str, cr_col: str = "CR", tokenizer=None,
                    exclude_src_span: bool = False, compat: bool = False, with_surfaces: bool = False) -> DataFrame:
    """One row per (window, chain, mention inside the window).

    The target mention is marked with ``*``; every mention of its chain inside
    the window (all but the target with ``exclude_src_span``) is tagged
    ``B``/``I`` on the marked text (N12).  Id is ``"{id}:{chain}:{mention}"``
    (unique; the reference restarts numbering per chain).  The output of all
    mentions of a row is built in an Arrow batch and exploded last, so text and
    chains do not ride through a fan-out; each output row's work is linear in
    its text plus its chain.
    """
    tok = tokenizer or HashVocab()

    def run(texts: pa.Array, lo: pa.Array, hi: pa.Array, begins: pa.Array, ends: pa.Array, numbers: pa.Array) -> pa.Array:
        rows, marked = [], []
        for text, l, h, bs, es, ns in zip(texts.to_pylist(), lo.to_pylist(), hi.to_pylist(), _lists(begins), _lists(ends), _lists(numbers)):
            out = []
            for number, b, e in zip(ns, bs, es) if text is not None else ():
                spans = _inside_window(l, h, b, e, compat)
                for mi, (tb, te) in enumerate(spans):
                    others = spans[:mi] + spans[mi + 1:] if exclude_src_span else spans
                    marked.append(f"{text[:tb]}*{text[tb:te]}*{text[te:]}")
                    out.append((number, mi, _moved(others, tb, te, compat)))
            rows.append(out)
        done = (x for some in groups(marked) for x in zip(some, tok.batch(some)))
        for out in rows:
            for i, (number, mi, spans) in enumerate(out):
                text, tokens = next(done)
                starts, stops = [t[2] for t in tokens], [t[3] for t in tokens]
                out[i] = (number, mi, text, [t[1] for t in tokens], _bio(starts, stops, spans),
                          _surfaces(tokens, starts, stops, spans) if with_surfaces else None)
        return _structs(rows, ["chain", "mi", "marked", "ids", "targets", "surfaces"],
                        [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())])

    made = fan_out(run, "array<struct<chain:int,mi:int,marked:string,ids:array<int>,targets:array<int>,surfaces:array<string>>>",
                   *_window(df, text_col, cr_col))
    t = bind_column(df, "_all", made)
    t = t.select(*[c for c in df.columns if c != text_col], F.explode("_all").alias("_one"))
    out = {
        "id": F.concat_ws(":", F.col(id_col).cast("string"), F.col("_one.chain").cast("string"), F.col("_one.mi").cast("string")),
        f"{text_col}_pretokenized": F.col("_one.marked"),
        text_col: F.col("_one.ids"),
        "targets": F.col("_one.targets"),
    }
    if with_surfaces:
        out["label_txt"] = F.col("_one.surfaces")
    names = [*df.columns, *[c for c in out if c not in df.columns]]
    return t.withColumns(out).select(*names)
