import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from textloom.llm import runs as R


def brute(w, least, times):
    """Every period in turn: maximal stretches of equal words a period apart, smallest periods only."""
    out = []
    for q in range(1, len(w) // times + 1):
        j, same = 0, [w[i] == w[i + q] for i in range(len(w) - q)]
        while j < len(same):
            k = j
            while k < len(same) and same[k]:
                k += 1
            size = k - j + q
            part = w[j:j + size]
            if k > j and size >= max(least, times * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((j, size, q))
            j = max(k, j + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_squares_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        w = [str(rng.randrange(rng.choice([1, 2, 3, 5]))) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.4:
            w = w[:10] + w[:rng.randint(1, 5)] * rng.randint(2, 8) + w[10:]
        assert sorted(R.stretch_runs(w, 2, 2), key=lambda r: (r[0], r[2])) == brute(w, 2, 2)


def texts(rng, n):
    for _ in range(n):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += [rng.choice("abcdefghij") for _ in range(rng.randint(0, 20))]
            p = [rng.choice("abcdefghij"[:rng.randint(1, 10)]) for _ in range(rng.randint(1, 12))]
            r = p * rng.randint(2, 7)
            w += r[:len(r) - rng.randint(0, len(p) - 1)]
        yield w


def test_runs_equal_brute_force():
    for w in texts(random.Random(2), 1500):
        assert R.runs(w) == brute(w, 24, 3)


def test_the_least_runs_lie_in_stretches():
    rng = random.Random(3)
    for q in range(1, 13):
        for _ in range(20):
            p = [f"p{i}" for i in range(q)]
            size = max(24, 3 * q)
            w = [f"l{i}" for i in range(rng.randint(0, 9))] + (p * 24)[:size] + [f"r{i}" for i in range(rng.randint(0, 9))]
            assert R.runs(w) == [(w.index("p0"), size, q)]
            assert R.runs(w[:w.index("p0")] + (p * 24)[:size - 1] + ["end"]) == []


def test_a_copied_passage_is_no_run():
    w = [f"w{i}" for i in range(300)]
    assert R.stretches(w + w + w[:50]) == [] and R.stretches(w + w + w[:200]) == [] and R.runs(w * 3) == [(0, 900, 300)]


def test_strongest_and_collapse():
    assert R.strongest([(0, 30, 10), (5, 24, 8), (9, 50, 10)]) == (9, 50, 10) and R.strongest([]) is None
    assert R.strongest([(0, 30, 10), (5, 24, 8)]) == (0, 30, 10)
    w = list("ab" * 15) + ["x"]
    assert R.collapse(w, R.runs(w)) == ["a", "b", "x"]


def test_periodic_tail():
    edited = 0
    for i in range(400):
        words = [f"w{j}" for j in range(i % 97)]
        h = zlib.crc32(str(i).encode())
        want = list(words)
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            edited += 1
        assert R.periodic_tail(i, words) == want
    assert edited > 20


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("edit", [False, True])
def test_runs_of_documents(spark, edge_docs, edge_rows, no_docs, edit):
    extra = [(i, " ".join(w)) for i, w in enumerate(texts(random.Random(4), 150), 1000)]
    rows = [(r[0], r[1]) for r in edge_rows if len(r[1] or "") < 20000] + extra
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        w = R.periodic_tail(i, w) if edit else w
        found = brute(w, 24, 3)
        best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
        dropped = {j for s, n, q in found for j in range(s + q, s + n)}
        want.append((i, len(found), *(best[0] if best else (None,) * 3), 1000 * best[0][1] // best[0][2] if best else None,
                     sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for j, x in enumerate(w) if j not in dropped))))
    docs = edge_docs.filter("text is null or length(text) < 20000").select("doc_id", "text", "words").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = [tuple(r) for r in R.periodic_runs(docs, edit=edit).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[1] for r in got)
    assert R.periodic_runs(no_docs).collect() == []
    assert len(R.periodic_runs(edge_docs, edit=edit).collect()) == len(edge_rows)
    full = {r.doc_id: r for r in R.periodic_runs(docs, edit=edit, full=True).collect()}
    assert [len(full[r[0]].runs) for r in want[-150:]] == [r[1] for r in want[-150:]] and sha(full[1000].collapsed) == want[-150][-1]


def test_long_text_is_walked_in_linear_memory():
    rng = np.random.default_rng(5)
    base = [str(x) for x in rng.integers(0, 50, 6000)]
    assert R.runs(base * 5 + ["end"]) == sorted([(0, 30000, 6000), *brute_short(base * 5)], key=lambda r: (r[0], r[2]))


def brute_short(w):
    return [r for r in brute_periods(w, 60) if r[1] >= max(24, 3 * r[2])]


def brute_periods(w, most):
    a, out = np.array(w), []
    for q in range(1, most):
        same = np.concatenate([[0], (a[q:] == a[:-q]).astype(int), [0]])
        edge = np.flatnonzero(np.diff(same))
        out += [(int(s), int(e - s + q), q) for s, e in zip(edge[::2], edge[1::2])]
    return out
