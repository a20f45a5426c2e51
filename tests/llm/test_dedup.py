import hashlib
import random
from collections import defaultdict

import pytest

from tests.llm.conftest import SCHEMA, syllables
from textloom.llm.common import components
from textloom.llm.exact_dedup import DigestIndex, exact_dedup
from textloom.llm.line_dedup import line_dedup
from textloom.llm.near_dup import forest, near_duplicates


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark, edge_docs, edge_rows, no_docs):
    got = sorted(map(tuple, exact_dedup(edge_docs, DigestIndex(spark)).collect()), key=str)
    groups = defaultdict(list)
    for r in edge_rows:
        groups[r[1] or ""].append(r[0])
    want = []
    for r in edge_rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup(no_docs, DigestIndex(spark)).collect() == []


def test_exact_dedup_goes_on_with_its_index(spark):
    index = DigestIndex(spark)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "a"), (10, "c"), (11, "c")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup(first, index).collect() if r.kept} == {2, 3}
    assert {r.doc_id for r in exact_dedup(second, index).collect() if r.kept} == {11}
    again = DigestIndex(spark, index.path, index.buckets)
    assert again.read().count() == 3


def words_of(text):
    out, word = [], ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def brute_near(rows, k, percent):
    sets = []
    for i, t in rows:
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    ids = [i for i, _ in rows]
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and ids[a] is not None and ids[b] is not None and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if s else i, (find(i) if s else i) == i) for i, s in zip(ids, sets)), key=str)


def test_near_dup_edge_rows(edge_docs, edge_rows, no_docs):
    for k, percent in ((3, 85), (5, 80)):
        got = sorted(map(tuple, near_duplicates(edge_docs, k, percent).collect()), key=str)
        assert got == brute_near([r[:2] for r in edge_rows], k, percent)
    assert near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("block", [8, 1024])
def test_near_dup_families(spark, block):
    """Families whose copies are linked to their origin, to each other or by a chain; small blocks use the star and the blocks."""
    rng = random.Random(block)
    rows = []
    for f in range(5):
        words = syllables(rng, 150).split()
        for c in range(30):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 6, 8])):
                own[rng.randrange(len(own))] = syllables(rng, 1) + str(c)
            rows.append((len(rows) * 7 % 151 + 1000 * f, " ".join(own)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df, block=block).collect()), key=str)
    want = brute_near(rows, 3, 85)
    assert got == want
    assert 5 < len({r[2] for r in want}) < len(rows)


def test_near_dup_forest_follows_the_threshold(spark):
    assert forest(85) == (32, 6)
    assert all((1 - (p / 100) ** d) ** t <= 3e-7 for p in range(5, 101) for t, d in [forest(p)])
    rng = random.Random(15)
    rows = []
    for i in range(60):  # two thirds of the words are shared: about half of the shingles
        words = syllables(rng, 300).split()
        rows += [(2 * i, " ".join(words[:200] + syllables(rng, 60).split())), (2 * i + 1, " ".join(words[:200] + syllables(rng, 60).split()))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=50).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in out)


def brute_lines(rows, min_words):
    """Each line that lies in a stretch of at least min_words words which stands earlier (apart from the stretch itself)."""
    docs = {}
    for i, t in rows:
        if i is not None and t is not None:
            docs[i] = [(n, x) for n, x in enumerate(t.split("\n")) if words_of(x)]
    first, at = {}, defaultdict(list)
    for i in sorted(docs):
        ls = docs[i]
        for a in range(len(ls)):
            words, b = 0, a
            while b < len(ls):
                words += len(words_of(ls[b][1]))
                b += 1
                if words >= min_words:
                    key = tuple(x for _, x in ls[a:b])
                    inner = words - len(words_of(ls[a][1])) < min_words or words - len(words_of(ls[b - 1][1])) < min_words
                    if inner:
                        place = (i, ls[a][0], ls[b - 1][0])
                        first.setdefault(key, place)
                        at[key].append(place)
    gone = defaultdict(set)
    for key, places in at.items():
        o = first[key]
        for p in places:
            if p[0] != o[0] or p[1] > o[2]:
                gone[p[0]].update(range(p[1], p[2] + 1))
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in rows if i is not None and t is not None}


def test_line_dedup(spark, no_docs):
    rng = random.Random(2)
    pool = [syllables(rng, rng.choice([3, 10, 20, 30, 60])) for _ in range(40)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(80)]
    run = "\n".join(pool[:6])
    rows += [(200 + i, f"own {i}\n{run}\nlast {i}") for i in range(30)] + [(300, "\n".join([pool[0]] * 40)), (301, None), (None, run), (302, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = line_dedup(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    want = brute_lines(rows, 50)
    assert {i: t for i, t in got.items() if t is not None} == want
    assert got[301] is None and want[210] == "own 10\nlast 10" and run in want[200] or run not in want[200]
    assert [r.text for r in out.collect() if r.doc_id is None] == [run]
    assert line_dedup(no_docs).collect() == []


def test_line_dedup_texts_that_share_an_id(spark):
    rng = random.Random(14)
    run = "\n".join(syllables(rng, 20) for _ in range(4))
    own = [syllables(rng, 60) for _ in range(8)]
    texts = [(1, run), (7, f"{own[0]}\n{run}\n{own[1]}"), (7, "\n".join(own[2:])), (7, "short"), (7, None)]
    out = line_dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    want = [(1, run), (7, f"{own[0]}\n{own[1]}"), (7, "\n".join(own[2:])), (7, "short"), (7, None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_line_dedup_edge_rows(edge_docs, edge_rows):
    out = line_dedup(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == len(edge_rows)
    assert SCHEMA.split(",")[0] == "doc_id long"


def test_a_small_batch_meets_only_its_own_digests(spark, monkeypatch):
    import textloom.llm.exact_dedup as ED

    index = DigestIndex(spark)
    assert exact_dedup(spark.range(3000).selectExpr("id as doc_id", "concat('t', id) as text"), index).filter("kept").count() == 3000
    seen, attach = [], ED.attach

    def spy(rows, table, key, weight, total, spread):
        seen.append((table.count(), total, table.agg({"group_size": "sum"}).first()[0]))
        return attach(rows, table, key, weight, total, spread)

    monkeypatch.setattr(ED, "attach", spy)
    batch = spark.createDataFrame([(5000 + i, f"t{i}") for i in range(0, 20)] + [(6000, "new"), (6001, "new")], "doc_id long, text string")
    out = {r.doc_id: r for r in exact_dedup(batch, index).collect()}
    assert seen == [(21, 22, 22)]  # the batch's digests, weighed by its own rows
    assert [i for i, r in out.items() if r.kept] == [6001] and out[5003].keep_id == 3 and out[6000].group_size == 2 and out[5003].group_size == 1
    assert index.read().count() == 3001


def test_null_ids_meet_an_earlier_null_id(spark):
    index = DigestIndex(spark)
    first = spark.createDataFrame([(None, "x"), (1, "y")], "doc_id long, text string")
    assert sorted(r.text_sha256 for r in exact_dedup(first, index).collect() if r.kept) == sorted(hashlib.sha256(t).hexdigest() for t in (b"x", b"y"))
    second = spark.createDataFrame([(None, "x"), (None, "z"), (2, "y")], "doc_id long, text string")
    assert [r.text_sha256 for r in exact_dedup(second, index).collect() if r.kept] == [hashlib.sha256(b"z").hexdigest()]


def test_an_index_is_opened_with_its_own_buckets(spark):
    index = DigestIndex(spark, buckets=8)
    exact_dedup(spark.range(200).selectExpr("id as doc_id", "concat('t', id) as text"), index)
    index.close()
    assert DigestIndex(spark, index.path, 8).read().count() == 200
    with pytest.raises(ValueError, match="buckets"):
        DigestIndex(spark, index.path, 16)
