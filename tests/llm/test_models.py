import math
import os
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.conftest import syllables
from tests.llm.test_dedup import words_of
from textloom.llm import lm_score
from textloom.llm.lm_score import Mixer, Vocabulary, huffman, path_counts, score
from textloom.llm.mixing import emit, mix, targets
from textloom.llm.quality import quality
from textloom.session import discard, materialise, released_shuffles


def brute_targets(sizes):
    """Shares by weight, cut at three times the size, the excess shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        goal = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        capped |= over


def test_targets(spark):
    rng = random.Random(9)
    for n in (1, 2, 5, 23):
        sizes = {f"s{i}": rng.choice([0, 1, 7, 100, 5000]) for i in range(n)} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-12, abs_tol=1e-9) for s in want)


def test_mix(spark, edge_docs, edge_rows, no_docs):
    rows = mix(edge_docs).collect()
    size = defaultdict(int)
    for r in edge_rows:
        size[r[3]] += len(words_of(r[1] or ""))
    goal = brute_targets(dict(size))
    assert len(rows) == len(edge_rows)
    for r in rows:
        rate = goal[r.source] / size[r.source] if size[r.source] else 0.0
        assert r.mix_size == len(words_of(r.text or "")) and r.mix_source_size == size[r.source]
        assert math.floor(rate) <= r.mix_copies <= math.ceil(rate) <= 3
    assert emit(mix(edge_docs), edge_docs.columns).count() == sum(r.mix_copies for r in rows)
    again = mix(edge_docs.repartition(7, "text")).collect()
    assert Counter((r.doc_id, r.text, r.mix_copies) for r in rows) == Counter((r.doc_id, r.text, r.mix_copies) for r in again)
    assert mix(no_docs).collect() == []


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(10)
    rows = [(i, "w " * rng.choice([10, 50, 200, 1000]), "big" if i % 3 else f"s{i % 10}") for i in range(3000)]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(
        F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= max(1000, 0.02 * r.target) for r in out)


def test_quality(spark, edge_docs, edge_rows, no_docs):
    docs, labels = spark.read.parquet(f"{SF_SMALL}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/../sf0.01/labels.parquet")
    # learn from two thirds of the labels, test on the others
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    out = quality(docs, labels.filter(~hidden)).join(labels.filter(hidden).select("doc_id", "quality"), "doc_id").collect()
    right = np.array([r.quality_keep == (r.quality > 0) for r in out])
    good = np.array([r.quality > 0 for r in out])
    assert right.mean() > 0.95 and right[good].mean() > 0.97
    marked = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    scored = quality(edge_docs, marked)
    assert scored.count() == len(edge_rows) and all(0 <= r.quality_score <= 1 for r in scored.collect())
    one = quality(edge_docs, marked.filter("quality = 1")).collect()
    assert all(r.quality_keep and r.quality_score is None for r in one)
    assert quality(no_docs, marked).collect() == []


def test_huffman_is_a_prefix_code():
    offset, length, nodes, bits = huffman(np.array([5, 1, 1, 9, 3]))
    assert math.isclose(sum(0.5 ** x for x in length), 1.0)
    paths = {tuple(bits[o:o + n]) for o, n in zip(offset, length)}
    assert len(paths) == 5


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute_base(rows):
    count, ends = Counter(), 0
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for i, t in rows:
        if not held(i):
            count.update(words_of(lower(t)))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    out = []
    for i, t in rows:
        c = [count[w] for w in words_of(lower(t))] + [ends]
        out.append((i, held(i), len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c)))
    return out


def test_lm_score(spark, edge_docs, edge_rows, no_docs, monkeypatch):
    cond = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    want = sorted(brute_base([r[:2] for r in edge_rows]), key=str)
    for frequent in (1 << 20, 50):
        monkeypatch.setattr("textloom.llm.lm_score.FREQUENT", frequent)
        got = sorted((tuple(r)[:6] for r in score(edge_docs, cond).collect()), key=str)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
    assert score(no_docs, cond).collect() == []


def test_lm_score_beats_its_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/../sf0.1/documents.parquet").select("doc_id", "text")
    out = score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).filter("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score < 0 for r in out)


def test_codes_are_complete():
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 3, 20, 100):
        hashes = rng.integers(0, 1 << 60, size, dtype=np.uint64)
        v = Vocabulary(hashes, rng.integers(1, 50, size), 9000, 7, np.ones(256, np.int64))
        at = np.concatenate([v.find(hashes), [-1, -1]]).astype(np.int64)
        is_end = np.arange(size + 2) == size + 1
        which, _, node, bit, _ = v.words(at, is_end)
        paths = [tuple(zip(node[which == i].tolist(), bit[which == i].tolist())) for i in range(size + 2)]
        assert len(set(paths)) == size + 2 and node.max() < len(v.odds)
        # at every node both ways lead on, and a node has one way to it: a binary tree
        nexts = {}
        for p in paths:
            for step, after in zip(p, [*p[1:], None]):
                nexts.setdefault(step, set()).add(after[0] if after else ("leaf", p))
        assert all(len(x) == 1 for x in nexts.values())
    assert v.find(np.array([3], np.uint64)).tolist() == [-1]
    assert syllables(random.Random(1), 2)


def test_lm_score_keeps_every_context_apart(spark):
    """Texts that training holds twice: what followed each pair of words is known, however many pairs there are."""
    rng = random.Random(12)
    pool = [f"w{i:04d}" for i in range(3000)]
    texts = [" ".join(rng.choice(pool) for _ in range(40)) for _ in range(5000)]
    rows = [(i, t, False) for i, t in enumerate(texts * 2)] + [(20000 + i, t, True) for i, t in enumerate(texts[:300])]
    out = score(spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(4), F.col("held")).filter("held_out").collect()
    assert len(out) == 300 and sum(r.score for r in out) > 0.5 * sum(r.base_score for r in out)


def test_lm_score_fits_its_weights_on_all_training_texts(spark, monkeypatch):
    """Twice the training documents are twice the bits behind the initial weights; held-out ones add none."""
    seen = []
    monkeypatch.setattr(Mixer, "tune", lambda self, bits, weights: seen.append(int(np.sum(bits))))
    for n in (600, 1200):
        rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(30)), i >= n) for i in range(n + 40)]
        score(spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3), F.col("held"))
    assert 1.7 < seen[-1] / seen[0] < 2.3


def test_path_counts():
    rng = np.random.default_rng(3)
    codes = [c for c in ("0", "100", "1010", "1011", "11")]
    pairs = sorted({(int(c), codes[k]): 0 for c, k in rng.integers(0, 5, (60, 2))})
    n = rng.integers(0, 4, len(pairs))
    flat, off = path_counts(np.array([c for c, _ in pairs]), np.array([int(w.ljust(64, "0"), 2) for _, w in pairs], np.uint64),
                            np.array([len(w) for _, w in pairs]), n)
    for i, (c, w) in enumerate(pairs):
        want = [sum(m for (d, x), m in zip(pairs, n) if d == c and x.startswith(w[:j])) for j in range(len(w) + 1)]
        assert flat[off[i]:off[i + 1]].tolist() == want


def chunks_of(texts, n_chunks):
    """``(code, data, ranks)``: chunks of ``(text, held out)`` rows as ``score`` makes them, without Spark."""
    count = Counter(w for t, out in texts if not out for w in t.encode().split())
    word = lambda t: lm_score._own_words([lm_score.Tokens(np.frombuffer(t, np.uint8), np.array([0, len(t)]))])[0]
    hashes = {int(word(w)): c for w, c in count.items()}
    rank = {h: i + 1 for i, h in enumerate(sorted(hashes, key=lambda h: (-hashes[h], h)))}
    per_count = np.array(sorted(Counter(hashes.values()).items(), reverse=True), np.int64)
    code = lm_score.Code(*per_count.T, sum(not out for _, out in texts), np.ones(256, np.int64), 2, sum(count.values()))
    out = []
    for i in range(n_chunks):
        rows = texts[i::n_chunks]
        table = pa.table([pa.array(range(len(rows))), pa.array([r[1] for r in rows]), pa.array([r[0] for r in rows])], names=["doc_id", "held_out", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        own = lm_score._own_words(t for *_, t in lm_score._slices(table))
        out.append((sink.getvalue().to_pybytes(), lm_score._pack(np.array([rank.get(int(h), 0) for h in own]))))
    return code, out


@pytest.mark.parametrize("part", [1 << 21, 300])
def test_lm_score_chunks_get_the_counts_of_all_training_texts(monkeypatch, part):
    """What the chunks know and the replies add up to what one place would have counted, for each predictor."""
    monkeypatch.setattr(lm_score, "PART", part)
    rng = random.Random(21)
    pool = [syllables(rng, 1 + i % 3) + str(i % 7) for i in range(400)]
    texts = [(" ".join(pool[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randrange(0, 90))), i % 7 == 2) for i in range(150)]
    texts += [texts[0]] * 3 + [("only " + "held" * 5, True), ("", False), ("", True)]
    code, rows = chunks_of(texts, 5)
    chunks = [lm_score.Chunk(code, *r) for r in rows]
    assert (code.n_parts.max() > 3) == (part == 300) and code.hot > 0
    for order in lm_score.PREDICTORS:
        asked = defaultdict(list)
        for c, chunk in enumerate(chunks):
            p = chunk.pairs[order]
            for where, at in p.asked():
                asked[where].append((where, order, c, lm_score._pack_pairs(p.contexts[p.context[at]], p.number[at], p.n[at])))
        replies = defaultdict(dict)
        for same in asked.values():
            for r in lm_score._reply(code)(pa.Table.from_batches([lm_score._parted(same)])).to_pylist():
                replies[r["chunk"]][r["part"]] = r["data"]
        total = Counter()
        for chunk in chunks:
            p = chunk.pairs[order]
            for context, c, size, n in zip(p.contexts[p.context].tolist(), p.code.tolist(), p.size.tolist(), p.n.tolist()):
                path = f"{c:064b}"[:size]
                for j in range(size + 1):
                    total[context, path[:j]] += n
        for k, chunk in enumerate(chunks):
            p = chunk.pairs[order]
            flat, off = p.counts(replies[k])
            for i, (context, c, size) in enumerate(zip(p.contexts[p.context].tolist(), p.code.tolist(), p.size.tolist())):
                path = f"{c:064b}"[:size]
                assert flat[off[i]:off[i + 1]].tolist() == [total[context, path[:j]] for j in range(size + 1)]
            assert not flat[off[-1]:].any()


def test_lm_score_packs_numbers():
    rng = np.random.default_rng(5)
    for columns in ([np.zeros(0, np.int64)], [np.arange(5), np.array([0, 1 << 40, 255])], [rng.integers(0, 1 << 62, 99)]):
        assert [c.tolist() for c in lm_score._unpack(lm_score._pack(*columns))] == [c.tolist() for c in columns]
    pairs = np.array(sorted({(int(h) << 31 | int(w), int(s)) for h, w, s in rng.integers(0, 9, (300, 3))}))
    n = rng.integers(0, 3, len(pairs))
    for a, b in ((pairs.T, n), (pairs[:1].T, n[:1])):
        assert [x.tolist() for x in lm_score._unpack_pairs(lm_score._pack_pairs(*a, b))] == [*a.tolist(), b.tolist()]


def stored(*folders):
    return sum(f.stat().st_size for d in folders for f in Path(d).rglob("*") if f.is_file())


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [files.apply(i).getPath() for i in range(files.size()) if "/shuffle_" in files.apply(i).getPath()]


def test_lm_score_holds_less_than_four_times_its_input_on_disk(spark, tmp_path, monkeypatch):
    """Tables between the steps are small and go when they have been read, and so do the shuffle files."""
    rng = random.Random(22)
    pool = [syllables(rng, 1 + i % 4) for i in range(20000)]
    rows = [(i, " ".join(pool[min(int(rng.paretovariate(0.7)), 19999)] for _ in range(400))) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/in")
    docs, folder = spark.read.parquet(f"{tmp_path}/in"), spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before, seen = stored(folder), []

    def watched(df, tag, **options):
        out = materialise(df, tag, **options)
        seen.append(stored(folder) - before)
        return out

    monkeypatch.setattr(lm_score, "materialise", watched)
    monkeypatch.setattr(lm_score, "PASSES", 0)
    old = set(shuffle_files(spark))
    out = score(docs, F.col("doc_id") % 7 == 2)
    assert out.count() == len(rows)
    assert max(seen) < 4 * stored(f"{tmp_path}/in")
    assert sum(os.path.getsize(f) for f in set(shuffle_files(spark)) - old) < 0.1 * stored(f"{tmp_path}/in")


def test_released_shuffles_and_discard(spark):
    from textloom.session import CLEANUP

    before, old = spark.conf.get(CLEANUP, None), set(shuffle_files(spark))
    with released_shuffles(spark):
        kept = materialise(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "kept")
        gone = materialise(kept.select("k"), "gone")
        discard(gone)
    assert spark.conf.get(CLEANUP, None) == before
    assert not set(shuffle_files(spark)) - old
    assert kept.count() == 7 and not any(os.path.exists(f.removeprefix("file:")) for f in gone.inputFiles())
