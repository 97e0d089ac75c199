"""Whitening against dense linear algebra, exact whole-number sums, clustered eigenvalues, odd rows."""

import numpy as np
import pytest

from labelmill.llm import whitening
from labelmill.llm.ship import ship
from tests.conftest import spark  # noqa: F401

SCHEMA = "vec_id long, embedding array<float>, x string, w double"


@pytest.fixture
def table(spark):  # noqa: F811
    return lambda vectors, ids=None: ship(spark).createDataFrame(
        [(i, v, "x", 0.0) for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA
    )


def rows_of(df):
    return {(r["vec_id"], r["component"]): r for r in df.collect()}


def test_whitening_equals_dense_algebra(table):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(300, 12)) * np.linspace(0.2, 1.5, 12)).astype(np.float32)
    odd = [None, [1.0] * 11 + [None], [1.0] * 11 + [float("nan")], [float("inf")] * 12, [], [1.0] * 5]
    got = rows_of(whitening.whiten(table([v.tolist() for v in good] + odd).repartition(5)))
    x = np.floor(1024 * good.astype(float)).astype(int) + 100_000
    n, total = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov((x - x.mean(0)).T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (x - x.mean(0)) @ vectors[:, :8] / np.sqrt(values[:8])
    assert set(got) == {(i, c) for i in range(n) for c in range(1, 9)}
    for c in range(8):
        mine = np.array([got[i, c + 1]["whitened"] for i in range(n)])
        sign = np.sign(mine @ want[:, c])
        assert np.abs(mine * sign - want[:, c]).max() < 1e-10
        assert abs(got[0, c + 1]["explained"] - values[c] / values.sum()) < 1e-12
    for (i, _), r in got.items():
        assert r["n"] == n and r["deviation"] == int(((n * x[i] - total) ** 2).sum()) and r["identity_error"] < 1e-10


def test_refinement_of_clustered_eigenvalues():
    rng = np.random.default_rng(0)
    q = whitening.orthonormal(np.linalg.qr(rng.normal(size=(40, 40)))[0].astype(np.longdouble))
    lam = np.concatenate([np.full(5, 7.0), 7 + 1e-9 * np.arange(1, 6), 3 + 1e-13 * np.arange(5), rng.uniform(0.1, 1, 25)])
    lam = np.sort(lam.astype(np.longdouble))[::-1]
    a = (q * lam) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.eigen(a)
    assert np.abs(values - lam).max() < 1e-15
    assert np.abs(a @ vectors - vectors * values).max() < 1e-15
    assert np.abs(vectors.T @ vectors - np.eye(40)).max() < 1e-16
    # the members of a narrow cluster are told apart, not only its space
    close = [i for i in range(40) if 7 < lam[i] < 7.1]
    assert all(abs(abs(vectors[:, i] @ q[:, i]) - 1) < 1e-9 for i in close)


def test_single_precision_alone_would_not_do():
    rng = np.random.default_rng(1)
    b = rng.normal(size=(200, 30))
    a = np.cov(b.T, bias=True).astype(np.longdouble)
    _, start = np.linalg.eigh(a.astype(np.float32))
    s = start.T.astype(np.longdouble) @ a @ start.astype(np.longdouble)
    assert np.abs(s - np.diag(np.diag(s))).max() > 1e-9
    _, vectors = whitening.eigen(a)
    s = vectors.T @ a @ vectors
    assert np.abs(s - np.diag(np.diag(s))).max() < 1e-15


def test_exact_products_beyond_float_precision():
    x = np.array([[1 << 29, 3], [(1 << 29) + 1, 5], [7, (1 << 28) - 1]])
    assert (whitening.exact_gram(x) == x.astype(object).T @ x.astype(object)).all()
    with pytest.raises(OverflowError):
        whitening.exact_gram(np.array([[1 << 40]]))
    for v in (0, 5, -5, 3 << 90, -(7 << 70) - 1, (1 << 60) - 1):
        assert whitening.long_double(v) == np.longdouble(str(v))


def test_cases(table):
    assert rows_of(whitening.whiten(table([]))) == {}
    assert rows_of(whitening.whiten(table([None, [float("nan")]]))) == {}
    one = rows_of(whitening.whiten(table([[1.0, 2.0]])))
    assert set(one) == {(0, 1), (0, 2)} and all(r["whitened"] is None and r["deviation"] == 0 for r in one.values())
    same = rows_of(whitening.whiten(table([[0.5, 1.0, 1.0], [0.5, 2.0, 1.0], [0.5, 2.0, 1.0]], [3, 3, None])))
    assert {k[1] for k in same} == {1, 2, 3}
    line = [r for r in whitening.whiten(table([[0.5, 1.0], [0.5, 2.0], [0.5, 2.0]], [3, 3, None])).collect()]
    assert sorted(str(r["vec_id"]) for r in line) == ["3", "3", "3", "3", "None", "None"]
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line)
    assert abs(line[0]["identity_error"]) < 1e-12
    ties = rows_of(whitening.whiten(table([[1.0], [2.0], [1.0, 2.0], [3.0, 5.0]])))
    assert {k[0] for k in ties} == {2, 3}  # of two lengths equally frequent, the longer one
