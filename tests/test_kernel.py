"""Kernel ridge and elastic net against dense solutions."""

import numpy as np
import pytest

from sigflow.operators import kernel as K
from sigflow.operators import ml as M
from test_ml import _table


def data(n=150, d=5):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, d)) * 3
    return x, np.stack([np.sin(x[:, 0]) + x[:, 1], x[:, 2] ** 2, np.zeros(n)], axis=1)


@pytest.mark.parametrize("dense, block", [(4096, 64 << 20), (10, 64 << 20), (10, 3_000)])
def test_kernel_ridge_equals_a_dense_solve(spark, monkeypatch, dense, block):
    monkeypatch.setattr(K, "DENSE_ROWS", dense)
    monkeypatch.setattr(K, "BLOCK_BYTES", block)
    n = 150 if block > 10_000 else 60
    x, y = data(n)
    df = _table(spark, x, y).repartition(3)
    got = {r.row_id: r.pred for r in K.predict_kernel(df, K.fit_kernel_ridge(df, 1.0, 1 / 20)).collect()}
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 20)
    want = k @ np.linalg.solve(k + np.eye(n), y)
    assert np.allclose([got[str(i)] for i in range(n)], want, atol=1e-7)


@pytest.mark.parametrize("dense", [20, 10])
def test_kernel_ridge_takes_equal_rows_once(spark, monkeypatch, dense):
    """200 rows of 20 feature vectors are a system of 20."""
    monkeypatch.setattr(K, "DENSE_ROWS", dense)
    x, y = data(200)
    x = x[np.minimum(np.arange(200) ** 2 // 1000, 19)]                   # groups of unequal size
    df = _table(spark, x, y).repartition(3)
    model = K.fit_kernel_ridge(df, 1.0, 1 / 20)
    assert model.rows.count() == 20
    got = {r.row_id: r.pred for r in K.predict_kernel(df, model).collect()}
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 20)
    want = k @ np.linalg.solve(k + np.eye(200), y)
    assert np.allclose([got[str(i)] for i in range(200)], want, atol=1e-7)


def test_elastic_net_is_optimal(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)) + 2
    x[:, 7] = 4.0                                          # constant
    x[:, 6] = x[:, 5] + 1e-3 * rng.normal(size=400)        # nearly the same
    y = np.stack([x[:, 0] - 2 * x[:, 1], 0.01 * x[:, 2], x[:, 5]], axis=1) + 0.1 * rng.normal(size=(400, 3))
    m = M.elastic_net_fit(_table(spark, x, y), 0.1, 0.5)
    xc, yc = x - x.mean(0), y - y.mean(0)
    slope = xc.T @ (yc - xc @ m.coef) / 400 - 0.05 * m.coef
    active = m.coef != 0
    assert np.abs(slope[active] - 0.05 * np.sign(m.coef[active])).max() < 1e-8
    assert (np.abs(slope[~active]) <= 0.05 + 1e-8).all() and active.any() and (~active).any()
    assert np.allclose(m.intercept, y.mean(0) - x.mean(0) @ m.coef)


def test_linear_models_share_statistics(spark):
    x, y = data()
    df = _table(spark, x, y)
    s = M.linear_stats(df)
    assert np.allclose(M.ridge_fit(df).coef, M.ridge_from(s).coef)
    assert np.allclose(M.elastic_net_fit(df).coef, M.elastic_net_from(s).coef)
