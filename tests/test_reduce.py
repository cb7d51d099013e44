"""PCA by block Krylov iteration against an eigen-solver; graph weights against
a plain loop."""

import math

import numpy as np
import pytest

from sigflow.operators import reduce as R


def naive(x, k, scale):
    z = x - x.mean(axis=0)
    if scale:
        s = z.std(axis=0)
        z = z / np.where(s < 1e-14, 1.0, s)
    u, w, vt = np.linalg.svd(z, full_matrices=False)
    v = vt[:k].T
    v = v * np.where(v[np.argmax(np.abs(v), axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return z @ v, (w ** 2 / (w ** 2).sum())[:k]


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("n, d, k, scale", [(80, 12, 3, True), (80, 12, 12, False), (300, 150, 4, True), (20, 60, 5, False)])
def test_pca_equals_an_eigen_solver(spark, n, d, k, scale):
    rng = np.random.default_rng(n + d)
    x = rng.normal(size=(n, d)) @ np.diag(rng.uniform(0.2, 3, d)) + 5
    scores, ratios = R.pca(frame(spark, x), "id", "v", k=k, scale=scale)
    want, share = naive(x, k, scale)
    got = np.array([list(r)[1:] for r in sorted(scores.collect())])
    assert np.abs(got - want).max() < 1e-6
    assert np.abs(np.array([r[1] for r in sorted(ratios.collect())]) - share).max() < 1e-10


def test_pca_restarts_with_a_full_basis(spark, monkeypatch):
    monkeypatch.setattr(R, "BASIS", 1)
    monkeypatch.setattr(R, "BLOCK", 2)
    x = np.random.default_rng(2).normal(size=(400, 120))
    scores, ratios = R.pca(frame(spark, x), "id", "v", k=2)
    want, share = naive(x, 2, True)
    assert np.abs(np.array([r[1] for r in sorted(ratios.collect())]) - share).max() < 1e-10
    assert np.abs(np.array([list(r)[1:] for r in sorted(scores.collect())]) - want).max() < 1e-5


def test_pca_of_wide_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)) * [9, 5, 2] @ rng.normal(size=(3, 12328)) + rng.normal(size=(40, 12328)) * 0.1
    scores, ratios = R.pca(frame(spark, x), "id", "v", k=3)
    want, share = naive(x, 3, True)
    assert np.abs(np.array([r[1] for r in sorted(ratios.collect())]) - share).max() < 1e-9
    assert np.abs(np.array([list(r)[1:] for r in sorted(scores.collect())]) - want).max() < 1e-5


def test_pca_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, 2.0])], "id long, v array<double>")
    scores, ratios = R.pca(df, "id", "v", k=2)                        # constant vectors: nothing varies
    assert sorted((r.id, r.pc1, r.pc2) for r in scores.collect()) == [(1, 0.0, 0.0), (2, None, None), (3, 0.0, 0.0)]
    assert [r[1] for r in ratios.collect()] == [0.0, 0.0]
    scores, ratios = R.pca(df.limit(0), "id", "v", k=2)
    assert scores.count() == 0 and ratios.count() == 0
    with pytest.raises(ValueError):
        R.pca(df, "id", "v", k=3)


def test_graph_weights_equal_a_plain_loop(spark):
    x = np.random.default_rng(6).normal(size=(40, 3))
    k = 6
    got = {(r.a, r.b): r.weight for r in R.neighbor_graph(frame(spark, x), "id", "v", k=k, scale=False).collect()}
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2))
    one = {}
    for i in range(len(x)):
        near = [j for j in np.argsort(d[i], kind="stable")[:k] if j != i]
        rho = min(d[i][j] for j in near)
        lo, hi = 1e-9, 1e3
        for _ in range(200):
            mid = (lo + hi) / 2
            if sum(math.exp(-max(0, d[i][j] - rho) / mid) for j in near) > math.log2(k):
                hi = mid
            else:
                lo = mid
        for j in near:
            one[i, j] = math.exp(-max(0, d[i][j] - rho) / lo)
    want = {}
    for i, j in one:
        a, b = one.get((i, j), 0.0), one.get((j, i), 0.0)
        want[min(i, j), max(i, j)] = a + b - a * b
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-7 for e in want)
