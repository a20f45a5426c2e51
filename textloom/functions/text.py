"""Prompt and text functions (S1-S13), all built-in Catalyst expressions.

Every function takes and returns ``Column`` objects so that a chain of them
collapses into one projection inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``\s`` and ``\w`` spelled as Java regex classes (code-point exact for
# Unicode 15.1; see README "Character classes").
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD_CLASS = r"_\p{L}\p{N}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_space(text) -> Column:
    """Every run of Unicode whitespace becomes one space (no strip)."""
    return F.regexp_replace(_c(text), f"[{SPACE_CLASS}]+", " ")


def join_collapse(parts: list, sep: str = " ") -> Column:
    """Join with ``sep`` then collapse whitespace."""
    return collapse_space(F.concat_ws(sep, *[_c(p) for p in parts]))


def pad_punctuation(text) -> Column:
    """S3: surround every char that is not ``_``, whitespace or a word char with spaces, then S1."""
    padded = F.regexp_replace(_c(text), f"([^{SPACE_CLASS}{WORD_CLASS}])", " $1 ")
    return collapse_space(padded)


def label_name(label, names: list[str], unknown: str = "<unk>") -> Column:
    """S5 with class names: ``names[label]`` or ``unknown`` when label < 0 (or out of range)."""
    arr = F.array(*[F.lit(n) for n in names])
    lab = _c(label)
    return F.when(lab >= 0, F.coalesce(F.get(arr, lab), F.lit(unknown))).otherwise(F.lit(unknown))


def label_id(label, no_label_idx: int = 0) -> Column:
    """S5 without names: the id, or ``no_label_idx`` when label < 0."""
    lab = _c(label)
    return F.when(lab >= 0, lab).otherwise(F.lit(no_label_idx))


def classify_prompt(keys: list[str], benchmark: str | None = None, with_key_names: bool = True,
                    sep: str = " ") -> Column:
    """``[benchmark] key1: v1 key2: v2`` (key names optional)."""
    parts: list[Column] = []
    if benchmark:
        parts.append(F.lit(benchmark))
    for k in keys:
        parts.append(F.concat(F.lit(f"{k}: "), F.col(k)) if with_key_names else F.col(k))
    return F.concat_ws(sep, *parts)


def one_decimal(x) -> Column:
    """``"{:.1f}"``: half-up on the decimal text (see README for the tie contract)."""
    return F.format_string("%.1f", _c(x).cast("double"))


def regression_target(labels_col: str, mode: str = "string", benchmark: str | None = None) -> Column:
    """Target from a ``labels`` struct.

    mode ``string``: one-decimal text of ``label`` (prefixed by benchmark name when given);
    ``real``: ``real-label``; ``binary``: ``binary-label``.
    """
    s = F.col(labels_col)
    if mode == "string":
        txt = one_decimal(s.getField("label"))
        return F.concat_ws(" ", F.lit(benchmark), txt) if benchmark else txt
    if mode == "real":
        return s.getField("real-label").cast("double")
    if mode == "binary":
        return s.getField("binary-label").cast("int")
    raise ValueError(f"unknown regression mode {mode!r}")


def mark_entity(text, word, start, mark: str) -> Column:
    """Put ``mark`` before and after ``word`` iff the text at 0-based ``start`` equals it.

    Literal comparison (no regex), so entity words with regex characters are safe.
    """
    t, w, s = _c(text), _c(word), _c(start)
    n = F.length(w)
    hit = F.substring(t, s + 1, n) == w
    marked = F.concat(
        F.substring(t, F.lit(1), s),
        F.lit(mark), w, F.lit(mark),
        F.substring(t, s + n + 1, F.length(t) + 1),
    )
    return F.when(hit, marked).otherwise(t)


def mark_subject_object(text, subj: str, obj: str, subj_mark: str = "*", obj_mark: str = "#") -> Column:
    """Mark the subject, then the object; the object start moves +2 when the
    subject starts before it."""
    s = F.col(subj)
    o = F.col(obj)
    t1 = mark_entity(text, s.getField("word"), s.getField("start_idx"), subj_mark)
    o_start = F.when(s.getField("start_idx") < o.getField("start_idx"), o.getField("start_idx") + 2) \
        .otherwise(o.getField("start_idx"))
    return mark_entity(t1, o.getField("word"), o_start, obj_mark)


def relation_prompt(text: str, subj: str, obj: str, benchmark: str | None = None,
                    with_key_name: bool = True) -> Column:
    """Marked sentence with optional ``text:`` key and benchmark prefix."""
    marked = mark_subject_object(text, subj, obj)
    body = F.concat(F.lit("text: "), marked) if with_key_name else marked
    return F.concat_ws(" ", F.lit(benchmark), body) if benchmark else body


def shifted_entities(subj: str, obj: str, prefix_len: int, end_inclusive: bool = True) -> tuple[Column, Column]:
    """Entity structs moved to the marked prompt.

    Each end gets +2 for its own two marks; the later entity gets +2 more on both
    ends (the earlier entity's marks precede it); then everything moves by the
    prompt prefix length.  ``end_inclusive`` states whether ``end_idx`` is the
    last character (the default for relation data) or one past it.
    """
    s, o = F.col(subj), F.col(obj)
    s_first = s.getField("start_idx") < o.getField("start_idx")

    def moved(e: Column, later: Column) -> Column:
        extra = F.when(later, F.lit(2)).otherwise(F.lit(0))
        start = e.getField("start_idx") + extra + prefix_len
        end = e.getField("end_idx") + 2 + extra + prefix_len
        return F.struct(
            e.getField("word").alias("word"),
            start.alias("start_idx"),
            end.alias("end_idx"),
            e.getField("type").alias("type"),
        )

    return moved(s, ~s_first), moved(o, s_first)


def generation_prompt(keys: list[str], prefix: str | None = None, with_key_names: bool = False,
                      sep: str = " ") -> Column:
    """``prefix`` then (optionally keyed) values."""
    parts: list[Column] = [F.lit(prefix)] if prefix else []
    for k in keys:
        parts.append(F.concat(F.lit(f"{k}: "), F.col(k)) if with_key_names else F.col(k))
    return F.concat_ws(sep, *parts)


def qa_prompt(question: str, context: str | None, benchmark: str, answers: str | None = None,
              impossible: str | None = None, pad_punct: bool = False) -> tuple[Column, Column]:
    """Returns (inputs, targets).

    With context: ``{benchmark} question: q context: c``; without:
    ``{benchmark} trivia question: q``; joined with S2.  Target: ``impossible``
    when the flag column is true, else the first answer.
    """
    q = F.col(question)
    c = F.col(context) if context else None
    if pad_punct:
        q = pad_punctuation(q)
        c = pad_punctuation(c) if c is not None else None
    if c is not None:
        inputs = join_collapse([F.lit(benchmark), F.lit("question:"), q, F.lit("context:"), c])
    else:
        inputs = join_collapse([F.lit(benchmark), F.lit("trivia question:"), q])
    if answers:
        ans = F.col(answers)
        if pad_punct:
            ans = F.transform(ans, lambda a: pad_punctuation(a))
        first = F.get(ans, 0)
    else:
        first = F.lit(None).cast("string")
    target = F.when(F.col(impossible), F.lit("impossible")).otherwise(first) if impossible else first
    return inputs, target


def template_fill(template: str, columns: list[str]) -> Column:
    """Fill ``{name}`` placeholders from columns (or ``{}`` in column order)."""
    import re

    parts: list[Column] = []
    pos = 0
    auto = iter(columns)
    for m in re.finditer(r"\{(\w*)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        name = m.group(1) or next(auto)
        parts.append(F.col(name).cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)
