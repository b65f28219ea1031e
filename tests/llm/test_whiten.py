"""Operator 11 against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from strophe.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, x double, n long"


def brute(vectors, k=4):
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], object)
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    dev = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    c = np.array([[n * a - b for a, b in zip(row, s, strict=True)] for row in fit], float) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    z = (np.array([[n * a - b for a, b in zip(row, s, strict=True)] for row in x], float) / n) @ q[:, :k] / np.sqrt(e[:k])
    return n, dev, z, e[:k] / e.sum()


def run(spark, rows, **kw):
    return whiten.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), **kw).orderBy("vec_id", "component").collect()


@pytest.mark.parametrize("d", [4, 7, 16])
def test_against_eigenvectors(spark, d, monkeypatch):
    monkeypatch.setattr(whiten, "FAN", 2)  # several levels of merging
    r = np.random.default_rng(d)
    v = (r.normal(size=(300, d)) @ np.diag(np.linspace(1, 4, d)) + 2).astype(np.float32)
    v[200:] = v[0]  # a third of all rows is one vector
    rows = [(i, x.tolist(), 0.5, 1) for i, x in enumerate(v)]
    odd = [(900, None, 0.5, 1), (901, [None, *v[1][1:].tolist()], 0.5, 1), (902, [math.nan, *v[1][1:].tolist()], 0.5, 1), (903, [math.inf, *v[1][1:].tolist()], 0.5, 1), (904, [], 0.5, 1), (905, v[1].tolist()[:-1], 0.5, 1)]
    got = run(spark, rows + odd)
    n, dev, z, share = brute([x for _, x, _, _ in rows])
    assert n == 200 and [(g.vec_id, g.component) for g in got] == [(i, c) for i in range(300) for c in range(1, 5)]
    mine = np.array([g.whitened for g in got]).reshape(300, 4)
    sign = np.sign((mine * z).sum(0))
    assert np.allclose(mine, z * sign, atol=1e-9)
    assert [g.deviation for g in got[::4]] == dev and {g.n for g in got} == {n}
    assert np.allclose([g.explained for g in got[:4]], share, rtol=1e-9)
    assert len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-9


def test_small_deviations_keep_their_digits():
    r = np.random.default_rng(3)
    q, _ = np.linalg.qr(r.normal(size=(6, 6)))
    sizes = np.array([1e8, 1e4, 1e2, 1, 1e-3, 1e-6])
    u, _ = np.linalg.qr(r.normal(size=(50, 6)))
    got, v = whiten.jacobi(np.linalg.qr((u * sizes) @ q.T, mode="r"))
    assert np.allclose(got[:5], sizes[:5], rtol=1e-8)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-12)


def test_odd_inputs(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 0.5, 1), (2, [], 0.5, 1)]) == []
    one = run(spark, [(1, [1.0, 2.0], 0.5, 1), (1, [1.0, 2.0], 0.5, 1), (None, [1.0, 2.0], 0.5, 1)])
    assert len(one) == 6 and {(g.n, g.deviation, g.whitened, g.explained, g.identity_error) for g in one} == {(1, 0, None, 0.0, None)}
    line = run(spark, [(i, [float(i), -2.0 * i, 7.0], 0.5, 1) for i in range(10)])
    assert [g.component for g in line[:3]] == [1, 2, 3] and all((g.whitened is None) == (g.component > 1) for g in line)
    assert line[0].explained == pytest.approx(1) and line[0].identity_error < 1e-9
    ties = run(spark, [(0, [1.0, 0.0], 0.5, 1), (1, [-1.0, 0.0], 0.5, 1), (2, [0.0, 1.0], 0.5, 1), (3, [0.0, -1.0], 0.5, 1)])
    assert [g.explained for g in ties] == pytest.approx([0.5] * 8) and ties[0].identity_error < 1e-12
    huge = run(spark, [(i, [3e38, float(i), -3e38], 0.5, 1) for i in range(5)])
    assert [g.deviation for g in huge if g.component == 1] == [(5 * 256 * i - 256 * 10) ** 2 for i in range(5)] and huge[0].identity_error < 1e-9
    wide = run(spark, [(i, [3e16 * (-1) ** i, float(i)], 0.5, 1) for i in range(6)])
    assert {g.deviation for g in wide} == {None} and all(g.whitened is not None for g in wide if g.component == 1)


def test_registered():
    from strophe.llm.queries import QUERIES

    assert "op11_embedding_whitening" in QUERIES
