"""Queries for tag, span and alignment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.tokens import HashVocab
from textloom.labels import CHAR_NER_IOB2, DEP_FUNCTIONS, DEP_RELATIONS, DEP_SYNTAX, NE_IOB2, NE_TYPES
from textloom.operators import spans as N
from textloom.plans import fixtures as FX
from textloom.plans import oracle_fixtures as O
from textloom.plans.registry import query

_IOB = O.sql_list(CHAR_NER_IOB2)
_NE_IOB = O.sql_list(NE_IOB2)
_O = CHAR_NER_IOB2.index("O")


def _txt(c):
    return F.array_join(c, " ")


def _txt_nulls(c):
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), " ")


# ---------------------------------------------------------------- N1-N3, N5


@query("tags_to_names", f"""
SELECT id, md5(array_to_string(list_transform(ner_tags, lambda t: {_IOB}[t + 1]), ' ')) AS names_md5,
       len(list_filter(ner_tags, lambda t: t <> {_O}))::INT AS n_tagged
FROM {O.CHARTAGS}""")
def tags_to_names(spark, sf):
    c = FX.chartags(spark, sf)
    names = N.tags_to_names("ner_tags", CHAR_NER_IOB2)
    return c.select("id", F.md5(_txt(names)).alias("names_md5"),
                    F.size(F.filter("ner_tags", lambda t: t != _O)).alias("n_tagged"))


_DEP_IDS = f"list_transform(string_split(text, ' '), lambda w, i: (length(w) * 7 + i - 1) % {len(DEP_RELATIONS)})"
_DEP_NAMES = f"list_transform({_DEP_IDS}, lambda t: {O.sql_list(DEP_RELATIONS)}[t + 1])"


@query("dependency_labels", f"""
SELECT id, md5(array_to_string(names, ' ')) AS names_md5,
       array_to_string(list_transform(names, lambda x: coalesce(list_position({O.sql_list(DEP_SYNTAX)}, string_split(x, '_')[1]), 0) - 1), ' ') AS syntax,
       array_to_string(list_transform(names, lambda x: coalesce(list_position({O.sql_list(DEP_FUNCTIONS)}, string_split(x, '_')[-1]), 0) - 1), ' ') AS functions
FROM (SELECT {O.CID} AS id, {_DEP_NAMES} AS names FROM conversations)""")
def dependency_labels(spark, sf):
    """Dependency relations: ids to names, and the syntax and function part of each name as an id (-1: none)."""
    from textloom.session import text_table

    c = text_table(spark, sf, "conversations")
    ids = F.transform(F.split("text", " ", -1), lambda w, i: ((F.length(w) * 7 + i) % len(DEP_RELATIONS)).cast("int"))
    d = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), N.tags_to_names(ids, DEP_RELATIONS).alias("names"))
    part = lambda n, tags: F.transform("names", lambda x: N.tag_id(F.substring_index(x, "_", n), tags))
    return d.select("id", F.md5(_txt("names")).alias("names_md5"), _txt(part(1, DEP_SYNTAX)).alias("syntax"), _txt(part(-1, DEP_FUNCTIONS)).alias("functions"))


_SPANS_SQL = f"""
WITH ch AS (SELECT id, u.i AS i, u.tag AS tag, len(tokens) AS n, array_to_string(tokens, '') AS text FROM (
              SELECT id, tokens, unnest(list_transform(ner_tags, lambda t, i: {{'i': i - 1, 'tag': {_IOB}[t + 1]}})) AS u
              FROM {O.CHARTAGS})),
     nb AS (SELECT *, min(CASE WHEN NOT starts_with(tag, 'I') THEN i END)
                      OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM ch)
SELECT id, i::INT AS "begin", coalesce(nxt, n)::INT AS "end", string_split(tag, '-')[-1] AS label,
       substr(text, i + 1, coalesce(nxt, n) - i) AS form
FROM nb WHERE starts_with(tag, 'B')"""


@query("char_tags_to_spans", _SPANS_SQL)
def char_tags_to_spans(spark, sf):
    c = N.char_example(FX.chartags(spark, sf))
    e = c.select("id", F.explode("NE").alias("s"))
    return e.select("id", F.col("s.begin").alias("begin"), F.col("s.end").alias("end"),
                    F.col("s.label").alias("label"), F.col("s.form").alias("form"))


@query("char_tags_to_spans_compat", _SPANS_SQL + " AND nxt IS NOT NULL")
def char_tags_to_spans_compat(spark, sf):
    c = N.char_example(FX.chartags(spark, sf), compat=True)
    e = c.select("id", F.explode("NE").alias("s"))
    return e.select("id", F.col("s.begin").alias("begin"), F.col("s.end").alias("end"),
                    F.col("s.label").alias("label"), F.col("s.form").alias("form"))


def _cover_sql(p: str) -> str:
    return f'list_filter("NE", lambda s: s.begin <= {p} AND {p} < s."end")'


@query("spans_to_char_tags", f"""
SELECT id, md5(array_to_string(list_transform(range(length(text)), lambda p:
         CASE WHEN len({_cover_sql('p')}) = 0 THEN {_O}
              ELSE list_position({_IOB}, (CASE WHEN {_cover_sql('p')}[1].begin = p THEN 'B-' ELSE 'I-' END)
                                         || {_cover_sql('p')}[1].label) - 1 END), ' ')) AS tags_md5
FROM {O.SPANS}""")
def spans_to_char_tags(spark, sf):
    s = FX.spans(spark, sf)
    t = N.spans_to_char_tags("NE", F.length("text"), CHAR_NER_IOB2)
    return s.select("id", F.md5(_txt(t)).alias("tags_md5"))


# ---------------------------------------------------------------- N4, N6-N8

_TOKS = O.with_tokens(O.SPANS)


@query("char_to_token", f"""
SELECT id, md5(array_to_string(list_transform(range(length(text)), lambda p:
         coalesce((list_position(list_transform(toks, lambda t: t.start <= p AND p < t."end"), true) - 1)::VARCHAR, '-')),
       ' ')) AS c2t_md5, len(toks)::INT AS n_tokens
FROM {_TOKS}""")
def char_to_token(spark, sf):
    s = FX.spans(spark, sf).withColumn("toks", HashVocab().tokens("text"))
    c2t = N.char_to_token("toks", F.length("text"))
    return s.select("id", F.md5(_txt_nulls(c2t)).alias("c2t_md5"), F.size("toks").alias("n_tokens"))


def _token_tags_sql(spans: str, label_expr, tags: str, outside: int) -> str:
    """Per token: the last span of the list that overlaps it; B when it is that span's first overlapping token."""
    ov = f'list_filter({spans}, lambda s: s.begin < t."end" AND s."end" > t.start)'
    last = f"{ov}[-1]"
    first_tok = (f'list_position(list_transform(toks, lambda u: u.start < {last}."end" AND u."end" > {last}.begin), true)')
    return f"""list_transform(toks, lambda t, i: CASE WHEN len({ov}) = 0 THEN {outside}
        ELSE list_position({tags}, (CASE WHEN {first_tok} = i THEN 'B-' ELSE 'I-' END) || {label_expr(last)}) - 1 END)"""


@query("token_tags", f"""
SELECT id, array_to_string({_token_tags_sql('"NE"', lambda s: f'{s}.label', _IOB, _O)}, ' ') AS tags FROM {_TOKS}""")
def token_tags(spark, sf):
    s = FX.spans(spark, sf).withColumn("toks", HashVocab().tokens("text"))
    t = N.spans_to_token_tags("toks", "NE", CHAR_NER_IOB2)
    return s.select("id", _txt(t).alias("tags"))


_PAR = ("list_transform(range(len(ne_par.begin)), lambda k: "
        "{'begin': ne_par.begin[k + 1], 'end': ne_par.\"end\"[k + 1], 'label': ne_par.label[k + 1]})")


@query("token_tags_overlap", f"""
SELECT id, array_to_string({_token_tags_sql('"NE"', lambda s: f'{s}.label', _IOB, _O)}, ' ') AS tags
FROM {O.with_tokens(O.NESTED_SPANS)}""")
def token_tags_overlap(spark, sf):
    """N6 over spans that nest and cross, not in order of their begin."""
    s = FX.nested_spans(spark, sf).withColumn("toks", HashVocab().tokens("text"))
    return s.select("id", _txt(N.spans_to_token_tags("toks", "NE", CHAR_NER_IOB2)).alias("tags"))


def _last_cover_sql(p: str) -> str:
    return f'list_filter("NE", lambda s: s.begin <= {p} AND {p} < s."end")[-1]'


@query("char_tags_overlap", f"""
SELECT id, md5(array_to_string(list_transform(range(length(text)), lambda p:
         CASE WHEN {_last_cover_sql('p')} IS NULL THEN {_O}
              ELSE list_position({_IOB}, (CASE WHEN {_last_cover_sql('p')}.begin = p THEN 'B-' ELSE 'I-' END)
                                         || {_last_cover_sql('p')}.label) - 1 END), ' ')) AS tags_md5
FROM {O.NESTED_SPANS}""")
def char_tags_overlap(spark, sf):
    """N5 over spans that nest and cross."""
    s = FX.nested_spans(spark, sf)
    return s.select("id", F.md5(_txt(N.spans_to_char_tags("NE", F.length("text"), CHAR_NER_IOB2))).alias("tags_md5"))


@query("token_tags_parallel", f"""
SELECT id, array_to_string({_token_tags_sql(_PAR, lambda s: O.sql_list(NE_TYPES) + f'[{s}.label + 1]', _NE_IOB, NE_IOB2.index('O'))}, ' ') AS tags
FROM {_TOKS}""")
def token_tags_parallel(spark, sf):
    s = FX.spans(spark, sf).withColumn("toks", HashVocab().tokens("text"))
    sp = N.parallel_spans("ne_par", NE_TYPES)
    t = N.spans_to_token_tags("toks", sp, NE_IOB2)
    return s.select("id", _txt(t).alias("tags"))


def _bounds_sql(e: str, agg: str) -> str:
    idx = f'list_filter(list_transform(toks, lambda t, i: CASE WHEN t.start <= {e}.end_idx AND t."end" > {e}.start_idx THEN i - 1 END), lambda x: x IS NOT NULL)'
    return f"coalesce({agg}({idx}), -1)::INT"


@query("entity_token_bounds", f"""
SELECT id, variant, {_bounds_sql('subject_entity', 'list_min')} AS s_first, {_bounds_sql('subject_entity', 'list_max')} AS s_last,
       {_bounds_sql('object_entity', 'list_min')} AS o_first, {_bounds_sql('object_entity', 'list_max')} AS o_last
FROM {O.with_tokens("(SELECT *, 0 AS variant FROM " + O.ents(False) + " UNION ALL SELECT *, 1 AS variant FROM " + O.ents(True) + ")", "sentence")}""")
def entity_token_bounds(spark, sf):
    e = FX.ents(spark, sf).withColumn("variant", F.lit(0)).unionByName(
        FX.ents(spark, sf, swap=True).withColumn("variant", F.lit(1)))
    e = e.withColumn("toks", HashVocab().tokens("sentence"))
    b = N.entity_token_bounds("toks", F.length("sentence"), [F.col("subject_entity"), F.col("object_entity")])
    e = e.withColumn("b", b)

    def get(i, j):
        return F.coalesce(F.get(F.get("b", i), j), F.lit(-1)).cast("int")

    return e.select("id", "variant", get(0, 0).alias("s_first"), get(0, 1).alias("s_last"),
                    get(1, 0).alias("o_first"), get(1, 1).alias("o_last"))


# ---------------------------------------------------------------- N9


def _windows_sql(src: str, id_expr: str, text: str, L: int, S: int) -> str:
    step = min(L, S)
    return f"""(SELECT *, {id_expr} || ':' || w::VARCHAR AS wid,
       toks[w * {step} + 1].start AS span_ch_start,
       toks[w * {step} + least({L}, len(toks) - w * {step})]."end" AS span_ch_end
  FROM (SELECT *, unnest(range(0, CASE WHEN len(toks) <= {L} THEN 0 ELSE ceil((len(toks) - {L}) / {step})::BIGINT END + 1)) AS w
        FROM {O.with_tokens(src, text)} WHERE len(toks) > 0))"""


@query("doc_windows", f"""
SELECT wid AS id, span_ch_start::INT AS span_ch_start, span_ch_end::INT AS span_ch_end,
       md5(substr(text, span_ch_start + 1, span_ch_end - span_ch_start)) AS text_md5
FROM {_windows_sql('documents', 'doc_id::VARCHAR', 'text', 448, 128)}""")
def doc_windows(spark, sf):
    from textloom.session import text_table

    d = text_table(spark, sf, "documents").select("doc_id", "text")
    w = N.doc_windows(d, "doc_id", "text")
    return w.select("id", "span_ch_start", "span_ch_end", F.md5("text").alias("text_md5"))


@query("fanout_split_sizes", f"""
SELECT lang AS split, count(*)::BIGINT AS num_examples
FROM {_windows_sql('documents', 'doc_id::VARCHAR', 'text', 448, 128)} GROUP BY lang""")
def fanout_split_sizes(spark, sf):
    """A4 after a fan-out: rows per split (``lang``) re-measured on the document windows."""
    from textloom.session import text_table
    from textloom.sources.reader import split_sizes

    d = text_table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("split"))
    return split_sizes(N.doc_windows(d, "doc_id", "text"), "split")


# ---------------------------------------------------------------- N10-N13

_WL, _WS = 40, 16


def _mention_windows_sql() -> str:
    w = _windows_sql(O.MENTIONS, "id", "text", _WL, _WS)
    return f"""(SELECT wid AS id, "CR", span_ch_start, span_ch_end,
       substr(text, span_ch_start + 1, span_ch_end - span_ch_start) AS text FROM {w})"""


def _valid_sql() -> str:
    """Per window: chains of mentions inside the window, shifted to window coordinates."""
    return """list_transform("CR".mention, lambda m: list_filter(list_transform(range(len(m.begin)), lambda k:
        {'begin': m.begin[k + 1] - span_ch_start, 'end': m."end"[k + 1] - span_ch_start, 'form': m.form[k + 1],
         'ok': span_ch_start <= m.begin[k + 1] AND m."end"[k + 1] <= span_ch_end}), lambda x: x.ok))"""


def _bio_sql(spans: str) -> str:
    ov = f'list_filter({spans}, lambda s: s.begin < t."end" AND s."end" > t.start)'
    last = f"{ov}[-1]"
    first_tok = f'list_position(list_transform(toks, lambda u: u.start < {last}."end" AND u."end" > {last}.begin), true)'
    return f"list_transform(toks, lambda t, i: CASE WHEN len({ov}) = 0 THEN 0 WHEN {first_tok} = i THEN 1 ELSE 2 END)"


@query("mention_tags", f"""
SELECT id, array_to_string({_bio_sql('flatten(valid)')}, ' ') AS targets, len(toks)::INT AS n_tokens
FROM {O.with_tokens("(SELECT *, " + _valid_sql() + " AS valid FROM " + _mention_windows_sql() + ")")}""")
def mention_tags(spark, sf):
    m = FX.mentions(spark, sf).select("id", "text", "CR")
    w = N.doc_windows(m, "id", "text", span_length=_WL, doc_stride=_WS, chains_col="CR")
    t = N.mention_tags(w, "text")
    return t.select("id", _txt("targets").alias("targets"), F.size("text").alias("n_tokens"))


_NESTED_CR = f"""(SELECT id, text, {{'mention': [
    {{'begin': list_transform("NE", lambda s: s.begin), 'end': list_transform("NE", lambda s: s."end"),
      'form': list_transform("NE", lambda s: s.label)}}]}} AS "CR" FROM {O.NESTED_SPANS})"""


@query("mention_tags_nested", f"""
SELECT id, array_to_string({_bio_sql('flatten(valid)')}, ' ') AS targets, len(toks)::INT AS n_tokens
FROM {O.with_tokens("(SELECT *, " + _valid_sql() + " AS valid FROM (SELECT wid AS id, \"CR\", span_ch_start, span_ch_end, "
                    "substr(text, span_ch_start + 1, span_ch_end - span_ch_start) AS text FROM "
                    + _windows_sql(_NESTED_CR, 'id', 'text', _WL, _WS) + "))")}""")
def mention_tags_nested(spark, sf):
    """N10 over mentions that nest and cross."""
    n = FX.nested_spans(spark, sf)
    chain = F.struct(F.col("NE.begin").alias("begin"), F.col("NE.end").alias("end"), F.col("NE.label").alias("form"))
    m = n.select("id", "text", F.struct(F.array(chain).alias("mention")).alias("CR"))
    t = N.mention_tags(N.doc_windows(m, "id", "text", span_length=_WL, doc_stride=_WS), "text")
    return t.select("id", _txt("targets").alias("targets"), F.size("text").alias("n_tokens"))


def _targets_sql() -> str:
    return f"""(SELECT id || ':' || (ci - 1)::VARCHAR || ':' || (mi - 1)::VARCHAR AS id, text, chain, tgt, ci, mi
  FROM (SELECT id, text, chain, ci, unnest(chain) AS tgt, generate_subscripts(chain, 1) AS mi
        FROM (SELECT id, text, unnest(valid) AS chain, generate_subscripts(valid, 1) AS ci
              FROM (SELECT *, {_valid_sql()} AS valid FROM {_mention_windows_sql()}))))"""


def _shift_sql(p: str) -> str:
    return f"({p} + CASE WHEN {p} > tgt.begin THEN 1 ELSE 0 END + CASE WHEN {p} >= tgt.\"end\" THEN 1 ELSE 0 END)"


def _marked_sql() -> str:
    return ("substr(text, 1, tgt.begin) || '*' || substr(text, tgt.begin + 1, tgt.\"end\" - tgt.begin) || '*' || "
            "substr(text, tgt.\"end\" + 1)")


def _augment_sql(exclude: bool) -> str:
    cands = "list_filter(chain, lambda c, j: j <> mi)" if exclude else "chain"
    moved = f"list_transform({cands}, lambda c: {{'begin': {_shift_sql('c.begin')}, 'end': {_shift_sql('c.\"end\"')}}})"
    inner = f"(SELECT id, {_marked_sql()} AS marked, {moved} AS cands FROM {_targets_sql()})"
    surf = ("list_transform(list_sort(cands), lambda c: array_to_string(list_transform(list_filter(toks, "
            "lambda t: t.start < c.\"end\" AND t.\"end\" > c.begin), lambda t: t.tok), ' '))")
    return f"""SELECT id, md5(marked) AS marked_md5, array_to_string({_bio_sql('cands')}, ' ') AS targets,
       array_to_string({surf}, '|') AS label_txt
FROM {O.with_tokens(inner, 'marked')}"""


@query("mention_mark", f"""
SELECT id, md5({_marked_sql()}) AS marked_md5,
       array_to_string(list_transform(chain, lambda c: {_shift_sql('c.begin')}::VARCHAR || '-' || {_shift_sql('c."end"')}::VARCHAR), ' ') AS cands
FROM {_targets_sql()}""")
def mention_mark(spark, sf):
    return _mark(spark, sf, False)


def _mark(spark, sf, compat: bool):
    m = FX.mentions(spark, sf).select("id", "text", "CR")
    w = N.doc_windows(m, "id", "text", span_length=_WL, doc_stride=_WS)
    lo, hi = F.col("span_ch_start"), F.col("span_ch_end")
    chains = F.col("CR").getField("mention")
    valid = F.transform(chains, lambda ms: F.transform(
        F.filter(F.arrays_zip(ms["begin"].alias("begin"), ms["end"].alias("end"), ms["form"].alias("form")),
                 lambda x: (lo <= x["begin"]) & (x["end"] <= hi)),
        lambda x: F.struct((x["begin"] - lo).alias("begin"), (x["end"] - lo).alias("end"), x["form"].alias("form"))))
    t = w.withColumn("_v", valid).select("id", "text", F.posexplode("_v").alias("ci", "chain"))
    t = t.select("id", "text", "ci", "chain", F.posexplode("chain").alias("mi", "tgt"))
    marked, moved = N.mark_mention(F.col("text"), F.col("tgt"), F.col("chain"), compat=compat)
    return t.select(F.concat_ws(":", "id", F.col("ci").cast("string"), F.col("mi").cast("string")).alias("id"),
                    F.md5(marked).alias("marked_md5"),
                    F.array_join(F.transform(moved, lambda c: F.concat_ws("-", c["begin"].cast("string"),
                                                                          c["end"].cast("string"))), " ").alias("cands"))


def _compat_sql() -> str:
    two = "CASE WHEN c.begin > tgt.\"end\" THEN 2 ELSE 0 END"
    return f"(c.begin + {two})::VARCHAR || '-' || (c.\"end\" + CASE WHEN c.begin > tgt.\"end\" OR c.\"end\" = tgt.\"end\" THEN 2 ELSE 0 END)::VARCHAR"


@query("mention_mark_compat", f"""
SELECT id, md5({_marked_sql()}) AS marked_md5, array_to_string(list_transform(chain, lambda c: {_compat_sql()}), ' ') AS cands
FROM {_targets_sql()}""")
def mention_mark_compat(spark, sf):
    """N11 with the shifts of the compat rule."""
    return _mark(spark, sf, True)


def _augment(spark, sf, exclude: bool):
    m = FX.mentions(spark, sf).select("id", "text", "CR")
    w = N.doc_windows(m, "id", "text", span_length=_WL, doc_stride=_WS, chains_col="CR")
    a = N.mention_augment(w, "id", "text", exclude_src_span=exclude, with_surfaces=True)
    return a.select("id", F.md5("text_pretokenized").alias("marked_md5"), _txt("targets").alias("targets"),
                    F.array_join("label_txt", "|").alias("label_txt"))


@query("mention_augment", _augment_sql(False))
def mention_augment(spark, sf):
    return _augment(spark, sf, False)


@query("mention_augment_exclude", _augment_sql(True))
def mention_augment_exclude(spark, sf):
    return _augment(spark, sf, True)
