"""Ridge, metrics rules and splits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigflow.operators import ml as M


def _table(spark, X, Y, cells=None):
    rows = [(str(i), int(cells[i]) if cells is not None else i % 5, i % 7,
             [float(v) for v in X[i]], [float(v) for v in Y[i]]) for i in range(len(X))]
    return spark.createDataFrame(rows, "row_id string, cell_id int, drug_id int, features array<double>, "
                                       "y array<double>")


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(200, 4)) * [1, 10, 100, 0.1] + 5
    Y = X @ rng.normal(size=(4, 2)) + rng.normal(size=(200, 2))
    m = M.ridge_fit(_table(spark, X, Y), alpha=1.0)
    Xc, Yc = X - X.mean(0), Y - Y.mean(0)
    W = np.linalg.solve(Xc.T @ Xc + np.eye(4), Xc.T @ Yc)
    assert np.allclose(m.coef, W, atol=1e-9)
    assert np.allclose(m.intercept, Y.mean(0) - X.mean(0) @ W, atol=1e-9)


def test_r2_rules(spark):
    rows = [([1.0, 2.0], [1.0, 2.5]), ([1.0, 4.0], [1.0, 4.0]), ([1.0, 6.0], [1.0, 5.5])]
    df = spark.createDataFrame(rows, "y array<double>, pred array<double>")
    g, per = M.metrics(df)
    per = {r.target: r for r in per.collect()}
    assert per[0].r2 == 1.0                     # constant truth predicted exactly
    assert abs(per[1].r2 - (1 - 0.5 / 8.0)) < 1e-12
    df2 = spark.createDataFrame([([1.0], [2.0]), ([1.0], [0.0])], "y array<double>, pred array<double>")
    assert M.metrics(df2)[1].first().r2 == 0.0  # constant truth, imperfect


def test_splits_disjoint_and_complete(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(300, 2))
    t = _table(spark, X, X, cells=rng.integers(0, 17, 300))
    for strategy, col in (("random", "row_id"), ("cell_line", "cell_id"), ("drug", "drug_id")):
        s = M.split(t, strategy, 0.2, 42)
        assert s.count() == 300
        test_keys = {r[0] for r in s.where("is_test").select(col).distinct().collect()}
        train_keys = {r[0] for r in s.where(~F.col("is_test")).select(col).distinct().collect()}
        assert not (test_keys & train_keys)
        n_keys = len(test_keys | train_keys)
        assert len(test_keys) == int(np.ceil(0.2 * n_keys))


def test_kfold_sizes(spark):
    X = np.zeros((23, 1))
    folds = M.kfold(_table(spark, X, X), 5, 42).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [4, 4, 5, 5, 5]


def test_splits_and_folds_follow_md5_order(spark):
    import hashlib
    ids = [*range(57), 5, 5, None]                    # an id of three rows, a row without one
    df = spark.createDataFrame([(i, f"x{k}") for k, i in enumerate(ids)], "row_id int, _h string")
    order = sorted((i for i in ids if i is not None), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    got = M.split(df, "random", 0.25).collect()
    first = set(list(dict.fromkeys(order))[:math.ceil(0.25 * 57)])
    assert len(got) == 59 and all(r.is_test == (r.row_id in first) for r in got)
    got = M.kfold(df, 4).collect()
    starts, at = [0, 15, 30, 45], {}
    for i in dict.fromkeys(order):                    # rows of one id go where their first one lies, or one up
        spots = [k for k, v in enumerate(order) if v == i]
        at[i] = {sum(s <= spots[0] for s in starts[1:]), sum(s <= spots[-1] for s in starts[1:])}
    assert len(got) == 59 and all(r.fold in at[r.row_id] for r in got)
    assert M.split(df.limit(0), "random").count() == 0 and M.kfold(df.limit(0), 3).count() == 0
    assert {r.fold for r in M.kfold(df, 1).collect()} == {0}


def test_group_folds_equal_the_greedy_pass(spark):
    rng = np.random.default_rng(12)
    counts = {f"g{i:03d}": int(n) for i, n in enumerate([*rng.integers(1, 9, 60), 300, 41, 40, 40, 1, 1, 1])}
    rows = [(g, i) for g, n in counts.items() for i in range(n)] + [(None, -1)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(5)
    for folds in (1, 3, 5):
        load, want = [0] * folds, {}
        for g in sorted(sorted(counts, reverse=True), key=lambda g: -counts[g]):
            want[g] = int(np.argmin(load))
            load[want[g]] += counts[g]
        got = M.group_kfold(df, "g", folds).select("g", "fold").distinct().collect()
        assert {r.g: r.fold for r in got} == want
    assert M.group_kfold(df.limit(0), "g", 3).count() == 0


def test_dealing_in_phases_equals_one_by_one():
    rng = np.random.default_rng(13)
    for _ in range(200):
        load = [int(v) for v in rng.integers(0, 60, rng.integers(1, 6))]
        size, count = int(rng.integers(1, 9)), int(rng.integers(1, 50))
        one, want = list(load), []
        for _ in range(count):
            want.append(int(np.argmin(one)))
            one[want[-1]] += size
        phases = M._deal(load, size, count)
        got = []
        for p in range(count):
            at, turn = [x for x in phases if x[0] <= p][-1]
            got.append(turn[(p - at) % len(turn)])
        assert got == want and load == one


def _by_hand(X, Y, fold, k, fit):
    """Mean R^2 over targets of fold k, scaled and fitted on the others."""
    tr, te = fold != k, fold == k
    m, s = X[tr].mean(0), X[tr].std(0)
    flat = X[tr].min(0) == X[tr].max(0)
    m[flat], s[flat] = X[tr][0, flat], 1.0
    Z, c = (X - m) / s, Y[tr].mean(0)
    P = Z[te] @ fit(Z[tr], Y[tr] - c) + c
    return np.mean(1 - ((Y[te] - P) ** 2).sum(0) / ((Y[te] - Y[te].mean(0)) ** 2).sum(0))


def _odd_folds(spark, monkeypatch):
    """A table with a constant column, one that varies in a single group, one far
    from 0 and one with an outlier, and its tables written by the code under test."""
    rng = np.random.default_rng(21)
    cells = rng.integers(0, 7, 260)
    X = rng.normal(size=(260, 6)) * [1, 1, 1, 1e-3, 1, 1]
    X[:, 0], X[:, 1], X[:, 3], X[7, 4] = 0.1, 0.3 + (cells == 2), X[:, 3] + 1e5, 1e9
    Y = X[:, [2, 5]] @ rng.normal(size=(2, 3)) + 1e3 * (X[:, [3]] - 1e5) + rng.normal(size=(260, 3)) + 50
    written = []
    monkeypatch.setattr(M, "cut_lineage", lambda df, cut=M.cut_lineage: (written.append(df.columns), cut(df))[1])
    return _table(spark, X, Y, cells).repartition(3), X, Y, written


def test_linear_cross_validation_reads_the_table_for_all_folds_at_once(spark, monkeypatch):
    df, X, Y, written = _odd_folds(spark, monkeypatch)
    ridge = lambda A, B: np.linalg.solve(A.T @ A + np.eye(A.shape[1]), A.T @ B)
    for group, held in ((None, M.kfold(df, 4)), ("cell_id", M.group_kfold(df, "cell_id", 4))):
        fold = {int(r.row_id): r.fold for r in held.select("row_id", "fold").collect()}
        fold = np.array([fold[i] for i in range(len(X))])
        written.clear()
        got = M.cross_validate(df, 4, group)
        assert np.allclose(got["per_fold"], [_by_hand(X, Y, fold, k, ridge) for k in range(4)], rtol=1e-7)
        assert np.isclose(got["mean"], np.mean(got["per_fold"])) and np.isclose(got["std"], np.std(got["per_fold"]))
        assert sum("features" in c for c in written) == 1          # one table of rows, not one a fold


def test_fold_statistics_in_several_passes_are_the_same(spark, monkeypatch):
    df, X, Y, _ = _odd_folds(spark, monkeypatch)
    folds = M.kfold(df, 4)
    one = [M.elastic_net_from(s) for s in M.cross_stats(folds, 4)]
    monkeypatch.setattr(M, "FOLD_BYTES", 1)
    monkeypatch.setattr(M, "GRAM_ROWS", 4)
    monkeypatch.setattr(M, "FOLD_ROWS", 9)
    for a, s, k in zip(one, M.cross_stats(folds, 4), range(4)):
        b = M.elastic_net_from(s)
        assert np.allclose(a.coef, b.coef, rtol=1e-6) and np.allclose(a.intercept, b.intercept, rtol=1e-6)
        assert not b.coef[0].any()
        scaled = M.scale_train(folds.withColumn("is_test", F.col("fold") == k)).where(~F.col("is_test"))
        c = M.elastic_net_fit(scaled.withColumn("features", F.slice("features", 2, 5)))
        z = np.array([r.features for r in scaled.select("features").collect()])
        x = np.array([r.features for r in folds.where(F.col("fold") != k).select("features").collect()])
        assert np.allclose(np.sort(x @ b.coef + b.intercept, 0), np.sort(z[:, 1:] @ c.coef + c.intercept, 0), atol=1e-5)
    assert M.cross_validate(df, 4, scoring="neg_mse", model="ElasticNet")["mean"] < 0
    with pytest.raises(ValueError, match="folds without rows"):
        M.cross_validate(df.where("cell_id < 2"), 3, "cell_id")


def test_feature_rows_are_dealt_to_all_cores(spark):
    obs = spark.createDataFrame([(i, f"c{i % 3}", i % 5) for i in range(60)], "row_id long, cell_id string, drug_id int")
    y = obs.select("row_id", F.lit("P0").alias("pathway"), F.lit(1.0).alias("value"))
    basal = obs.select("cell_id").distinct().select("cell_id", F.lit("P0").alias("pathway"), F.lit(2.0).alias("value"))
    vecs = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 0.0]), (2, [1.0, -1.0]), (3, [2.0, None]), (None, [1.0, 1.0])]
    drugs = spark.createDataFrame(vecs, "drug_id int, vec array<double>")
    t, _, _ = M.prepare_features(obs.coalesce(1), y, basal, basal, drugs, drug_dim=2)
    got = t.collect()                                 # drug 0 twice; the others hold nothing, or have no vector
    assert sorted(r.row_id for r in got) == sorted([i for i in range(0, 60, 5)] * 2)
    assert {tuple(r.features) for r in got} == {(2.0, 2.0, 1.0, 0.0), (2.0, 2.0, 0.0, 1.0)}
    assert t.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
