"""DuckDB spellings of the derived inputs (same formulas as ``fixtures``) and of shared expressions."""

from __future__ import annotations

from textloom.labels import CHAR_NER_IOB2, CHAR_NER_TYPES

SPACE_RE = "[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]"
WORD_RE = "_\\p{L}\\p{N}"
SEP_RE = "[ \t\n\r]"


def sql_list(values) -> str:
    def q(v):
        return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "[" + ", ".join(q(v) for v in values) + "]"


def hash_id(expr: str, size: int = 32000) -> str:
    return f"(((('0x' || substr(md5({expr}), 1, 8))::BIGINT % {size}) + 3)::INT)"


def collapse(expr: str) -> str:
    return f"regexp_replace({expr}, '{SPACE_RE}+', ' ', 'g')"


def pad_punct(expr: str) -> str:
    cls = SPACE_RE[1:-1]
    return collapse(f"regexp_replace({expr}, '([^{cls}{WORD_RE}])', ' \\1 ', 'g')")


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{SEP_RE}'), lambda w: w <> '')"


def hash_ids(expr: str) -> str:
    return f"list_transform({words(expr)}, lambda w: {hash_id('w')})"


def with_tokens(src: str, text: str = "text", out: str = "toks") -> str:
    """Wrap ``src`` (a FROM item) adding ``out`` = list of {tok, id, start, end} for ``text``."""
    return f"""(SELECT * EXCLUDE (_pieces, _seps),
       list_filter(list_transform(_pieces, lambda w, i: {{'tok': w, 'id': {hash_id('w')},
            'start': ([0] || list_transform(_seps, lambda p: p + 1))[i]::INT,
            'end': (_seps || [length({text})::BIGINT])[i]::INT}}), lambda s: s.tok <> '') AS {out}
  FROM (SELECT *, regexp_split_to_array({text}, '{SEP_RE}') AS _pieces,
               list_filter(list_transform(string_split({text}, ''), lambda ch, j:
                   CASE WHEN ch IN (' ', chr(9), chr(10), chr(13)) THEN j - 1 ELSE -1 END), lambda p: p >= 0) AS _seps
        FROM {src}))"""


def with_space_words(src: str, text: str = "text", out: str = "wo") -> str:
    """Add ``out`` = list of {w, off} from splitting ``text`` on one space (empty words kept)."""
    return f"""(SELECT * EXCLUDE (_ws, _starts), list_transform(_ws, lambda w, i: {{'w': w, 'off': _starts[i]}}) AS {out}
  FROM (SELECT *, string_split({text}, ' ') AS _ws,
               [0] || list_transform(list_filter(list_transform(string_split({text}, ''), lambda ch, j:
                   CASE WHEN ch = ' ' THEN j - 1 ELSE -1 END), lambda p: p >= 0), lambda p: p + 1) AS _starts
        FROM {src}))"""


CID = "(conv_id::VARCHAR || ':' || turn::VARCHAR)"

CLS = """(SELECT d.doc_id AS id, d.text, d.lang, d.source, coalesce(l.quality, -1)::INT AS label, d.n_chars % 2 AS pred
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

PAIRS = f"""(SELECT u.conv_id::VARCHAR || ':' || u.turn::VARCHAR AS id, u.conv_id, u.turn,
       u.text AS target, a.text AS prediction, u.text AS question, a.text AS context,
       string_split(a.text, ' ')[1] AS answer, (u.turn % 4 = 0) AS is_impossible
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

SCORES = """(SELECT event_id AS id, value, event_type, props, round(value) / 10 AS label, value / 10 AS real_label,
       (value >= 50)::INT AS binary_label FROM events)"""


def _entity(k: int, etype: str) -> str:
    return (f"{{'word': wo[{k}].w, 'start_idx': wo[{k}].off::INT, "
            f"'end_idx': (wo[{k}].off + length(wo[{k}].w) - 1)::INT, 'type': '{etype}'}}")


def ents(swap: bool = False) -> str:
    s, o = _entity(2, "PER"), _entity(4, "ORG")
    if swap:
        s, o = o, s
    return f"""(SELECT {CID} AS id, conv_id, turn, text AS sentence, {s} AS subject_entity, {o} AS object_entity,
       (turn % 30)::INT AS label FROM {with_space_words('conversations')})"""


def _cls_expr(ch: str) -> str:
    return (f"(CASE WHEN {ch} IN ('a','e','i','o','u','A','E','I','O','U') THEN 'QT' "
            f"WHEN {ch} IN (',', '.') THEN 'LC' ELSE 'O' END)")


CHARTAGS = f"""(SELECT id, conv_id, turn, tokens,
       list_transform(tokens, lambda ch, i: list_position({sql_list(CHAR_NER_IOB2)},
           CASE WHEN {_cls_expr('ch')} = 'O' THEN 'O'
                ELSE (CASE WHEN i = 1 OR {_cls_expr('tokens[i - 1]')} <> {_cls_expr('ch')} THEN 'B-' ELSE 'I-' END)
                     || {_cls_expr('ch')} END)::INT - 1) AS ner_tags
  FROM (SELECT {CID} AS id, conv_id, turn, string_split(text, '') AS tokens FROM conversations))"""

SPANS = f"""(SELECT {CID} AS id, conv_id, turn, text,
       list_transform(list_filter(wo, lambda s: length(s.w) >= 6), lambda s: {{'form': s.w, 'begin': s.off::INT,
           'end': (s.off + length(s.w))::INT, 'label': {sql_list(CHAR_NER_TYPES)}[length(s.w) % 6 + 1]}}) AS "NE",
       {{'begin': list_transform(list_filter(wo, lambda s: length(s.w) >= 6), lambda s: s.off::INT),
         'end': list_transform(list_filter(wo, lambda s: length(s.w) >= 6), lambda s: (s.off + length(s.w))::INT),
         'label': list_transform(list_filter(wo, lambda s: length(s.w) >= 6), lambda s: (length(s.w) % 6)::INT)}} AS ne_par,
       wo
  FROM {with_space_words('conversations')})"""

def _stretch(words: int, every: int, at: int) -> str:
    last = f"wo[least(k + {words - 1}, len(wo))]"
    spans = (f"list_transform(wo, lambda s, k: {{'begin': s.off::INT, 'end': ({last}.off + length({last}.w))::INT, "
             f"'label': {sql_list(CHAR_NER_TYPES)}[(k - 1) % 6 + 1], 'k': k - 1}})")
    return f"list_filter({spans}, lambda s: s.k % {every} = {at} AND s.\"end\" > s.begin)"


NESTED_SPANS = f"""(SELECT {CID} AS id, text, {_stretch(2, 3, 0)} || {_stretch(1, 4, 1)} || {_stretch(3, 5, 2)} AS "NE"
  FROM {with_space_words('conversations')})"""

MENTIONS = f"""(SELECT c.conv_id::VARCHAR || ':' || c.turn::VARCHAR AS id, c.conv_id, c.turn, c.text, {{'mention': list_transform(coalesce(list_sort(chains), []),
           lambda x: {{'begin': x.b, 'end': x.e, 'form': x.f}})}} AS "CR"
  FROM conversations c LEFT JOIN (
        SELECT conv_id, turn,
               list({{'first': offs[1], 'b': offs, 'e': list_transform(offs, lambda o: o + length(w)),
                     'f': list_transform(offs, lambda o: w)}}) AS chains
        FROM (SELECT conv_id, turn, s.w AS w, list_sort(list(s.off::INT)) AS offs
              FROM (SELECT conv_id, turn, text, unnest(wo) AS s FROM {with_space_words('conversations')})
              WHERE length(s.w) >= 4
              GROUP BY conv_id, turn, text, s.w
              HAVING count(*) >= 2)
        GROUP BY conv_id, turn) m ON m.conv_id = c.conv_id AND m.turn = c.turn)"""

LOGITS = "(SELECT vec_id AS id, embedding::DOUBLE[] AS logits, label AS labels FROM embeddings)"

HISTORY = """(SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS step,
       round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END) * 100, 3) AS score, count(*)::BIGINT AS count
  FROM events GROUP BY 1)"""

VECTORS = """(SELECT label AS seq, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS pos,
       embedding AS vec, (CASE WHEN (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 4 <> 3
                          THEN 1 ELSE 0 END)::INT AS mask, vec_id FROM embeddings)"""

EOS_IDS = f"""(SELECT id, conv_id, turn, text,
       CASE WHEN len(_ids) >= turn + 3 THEN _ids[1:turn + 3] || [1] || _ids[turn + 4:] ELSE _ids END AS ids
  FROM (SELECT {CID} AS id, conv_id, turn, text, {hash_ids('text')} AS _ids FROM conversations))"""


def tagseq() -> str:
    o = CHAR_NER_IOB2.index("O")
    return f"""(SELECT id, conv_id, turn, text, labels,
       list_transform(labels, lambda t, i: (CASE WHEN (conv_id * 31 + turn * 7 + (i - 1)) % 5 = 0
                                                THEN (t + 1) % 13 ELSE t END)::INT) AS predictions,
       wo, "NE"
  FROM (SELECT *, list_transform(wo, lambda s: (CASE WHEN length(s.w) >= 6 THEN (length(s.w) % 6) * 2
                                                   ELSE {o} END)::INT) AS labels FROM {SPANS}))"""
