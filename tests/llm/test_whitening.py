import numpy as np
import pytest

from textloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, white int, v double"


def check_pairs(v, k):
    e, u = W.eigenpairs(v, k)
    size = max(np.abs(v).max(), 1e-300) * len(v)
    assert np.allclose(e / size, np.linalg.eigvalsh(v)[::-1][:k] / size, atol=1e-14)
    assert np.abs((v @ u.T - u.T * e) / size).max() < 1e-14 and np.abs(u @ u.T - np.eye(k)).max() < 1e-13
    return e


def test_eigenpairs():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 5, 64):
        a = rng.standard_normal((d + 5, d))
        check_pairs(a.T @ a, min(d, 32))
    q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    check_pairs(q @ np.diag(np.r_[np.full(20, 5.0), np.full(20, 5 + 1e-9), np.linspace(0, 1, 24)]) @ q.T, 40)
    a = rng.standard_normal((10, 64))
    for v in (np.eye(64), np.zeros((8, 8)), np.diag(np.r_[np.ones(10), np.arange(10.0)]), a.T @ a, np.ones((6, 6)), 1e-200 * np.eye(4), 1e200 * np.eye(4)):
        check_pairs(v, min(32, len(v)))
    wilkinson = np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    check_pairs(wilkinson, 21)


def test_sturm_counts():
    rng = np.random.default_rng(2)
    diag, off = rng.standard_normal(30), rng.standard_normal(29)
    off[7] = 0
    values = np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-4, 4, 101)
    assert W.below(diag, off, at).tolist() == [int((values < t).sum()) for t in at]


def brute(rows, k=32):
    """Plain NumPy over all rows, deviations in Python integers."""
    keep = [(r[0], np.array(r[1], np.float64)) for r in rows if r[1] and not any(c is None or not np.isfinite(c) for c in r[1])]
    x = np.array([np.floor(64 * np.float32(v).astype(np.float64)) for _, v in keep]).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in keep], dev, e, c @ u / np.sqrt(np.where(e > 1e-10 * e[0], e, np.nan)), e / np.trace(c.T @ c / n)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], None, 1, "c", 2, 0.5) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("d,count", [(40, 300), (5, 60), (40, 12)])
def test_whitening_equals_numpy(spark, d, count):
    rng = np.random.default_rng(d)
    rows = [(i, (rng.standard_normal(d) * np.linspace(3, 0.3, d) + 7).astype(np.float32).tolist()) for i in range(count)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (900, None), (901, []), (902, [float("nan")] * d), (903, [None, *rows[2][1][1:]]),
             (904, [*rows[3][1][1:], float("inf")])]
    ids, dev, e, white, explained = brute(rows)
    k, out = min(32, d), W.whiten(frame(spark, rows).repartition(5)).collect()
    assert len(out) == len(ids) * k and {r.n for r in out} == {len(ids)}
    assert sorted((r.deviation for r in out if r.component == 1)) == sorted(dev)
    got = {}
    for r in out:
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    usable = e > 1e-10 * e[0]
    assert usable.all() == (count > d)
    signs = None
    for i, dv, w in zip(ids, dev, white):
        mine = np.array([np.nan if got[(i, dv)][c + 1][0].whitened is None else got[(i, dv)][c + 1][0].whitened for c in range(k)])
        assert (np.isnan(mine) == ~usable).all()
        signs = np.sign(mine * w) if signs is None else signs
        assert np.allclose(mine[usable], (signs * w)[usable], atol=1e-7)
    for c in range(k):
        assert {r.explained for r in out if r.component == c + 1}.pop() == pytest.approx(explained[c], abs=1e-12)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-8


def test_flat_and_empty_tables(spark):
    assert W.whiten(frame(spark, [])).collect() == [] and W.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = W.whiten(frame(spark, rows)).collect()
        assert len(out) == 2 * len(rows) and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in out} == {(None, None, None, 0)}
    with pytest.raises(Exception, match="length|entries"):
        W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0])]).repartition(2)).collect()
    with pytest.raises(Exception, match="too large"):
        W.whiten(frame(spark, [(1, [1.0, 1e30])])).collect()


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 20], [0]])
    assert W.deviations(x, 10 ** 9, np.array([0])) == [None, 0]
    assert W.deviations(x, 2000, np.array([5])) == [(2000 * (1 << 20) - 5) ** 2, 25]
