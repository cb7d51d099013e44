"""Multi-output forests against a plain recursive tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigflow.operators import forest as T


def naive_tree(x, y, w, depth, min_leaf, cuts):
    """Rows one by one; thresholds from ``cuts``."""
    mean = (y * w[:, None]).sum(0) / w.sum()
    node = {"value": mean}
    if depth == 0 or len(x) < 2 * min_leaf:
        return node
    score = lambda on: ((y[on] * w[on, None]).sum(0) ** 2).sum() / w[on].sum()
    base, best = score(np.ones(len(x), bool)), None
    for f in range(x.shape[1]):
        for c in cuts[f]:
            low = x[:, f] <= c
            if min_leaf <= low.sum() <= len(x) - min_leaf:
                gain = score(low) + score(~low) - base
                if best is None or gain > best[0] + 1e-9 * abs(best[0]):
                    best = (gain, f, c)
    if best is None or best[0] <= 1e-12 * max(abs(base), 1e-300):
        return node
    _, f, c = best
    low = x[:, f] <= c
    parts = [naive_tree(x[s], y[s], w[s], depth - 1, min_leaf, cuts) for s in (low, ~low)]
    return node | {"feature": f, "cut": c, "gain": best[0], "low": parts[0], "high": parts[1]}


def naive_value(node, row):
    while "cut" in node:
        node = node["low"] if row[node["feature"]] <= node["cut"] else node["high"]
    return node["value"]


def gains(node, out):
    if "cut" in node:
        out[node["feature"]] += node["gain"]
        gains(node["low"], out), gains(node["high"], out)
    return out


def table(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n, 3)).round(1), rng.integers(0, 2, (n, 3)), np.ones((n, 1))], axis=1)
    y = np.stack([3 * x[:, 0] + x[:, 3], np.where(x[:, 1] > 0, 5.0, -5.0) * x[:, 4]], axis=1) + 0.3 * rng.normal(size=(n, 2))
    df = spark.createDataFrame([(f"r{i}", a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))],
                               "row_id string, features array<double>, y array<double>").repartition(5)
    hashes = {r[0]: r[1] for r in df.select("row_id", F.xxhash64("row_id")).collect()}
    h = np.array([hashes[f"r{i}"] for i in range(n)])
    return df, x, y, h


@pytest.mark.parametrize("local, hist", [(128 << 20, 256 << 20), (20_000, 256 << 20), (3_000, 30_000)])
def test_equals_naive_trees(spark, monkeypatch, local, hist):
    """Finished in tasks, split by histograms first, and by several passes a level."""
    monkeypatch.setattr(T, "LOCAL_BYTES", local)
    monkeypatch.setattr(T, "HIST_BYTES", hist)
    monkeypatch.setattr(T, "CHUNK_BYTES", 4_000)
    monkeypatch.setattr(T, "CELLS", 500)
    df, x, y, h = table(spark, 220, 4)
    forest = T.fit_forest(df, 4, 6, 5, seed=9)
    monkeypatch.setattr(T, "MODEL_BYTES", 2_000)
    found = {r.row_id: r.pred for r in T.predict_forest(df, forest).collect()}
    got = np.array([found[f"r{i}"] for i in range(len(x))])
    cuts = [T.cut_points(x[:, f], 256) for f in range(x.shape[1])]
    want, share = np.zeros_like(got), np.zeros(x.shape[1])
    for t in range(4):
        w = T.bootstrap(h, t, 9)
        tree = naive_tree(x[w > 0], y[w > 0], w[w > 0], 6, 5, cuts)
        want += np.array([naive_value(tree, r) for r in x]) / 4
        g = gains(tree, np.zeros(x.shape[1]))
        share += g / g.sum() / 4
    assert np.allclose(got, want, atol=1e-9)
    assert np.allclose(forest.importances, share, atol=1e-9)


def test_bins_decide_as_thresholds_do():
    """A tree over bin numbers places every row where the thresholds do, also
    values equal to one."""
    x = np.random.default_rng(1).normal(size=(300, 3)).round(1)
    edges = {f: np.unique(x[::3, f])[:-1] for f in (0, 2)}
    tree, _ = T.grow(T.binned(x, edges), x[:, :1] * x[:, 2:], np.ones(300), 6, 3, edges, 3)
    assert len(tree.feature) > 10
    assert (T.in_bins(tree, edges).place(T.binned(x, edges)) == tree.place(x)).all()


def test_bootstrap_is_poisson():
    w = T.bootstrap(np.random.default_rng(0).integers(-2**62, 2**62, 200_000), 3, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01


def test_quantile_cuts_and_constant_features(spark):
    cuts = T.cut_points(np.arange(10_000.0), 256)
    assert len(cuts) <= 255 and abs(np.diff(np.searchsorted(np.arange(10_000.0), cuts)) - 39).max() <= 1
    df = spark.createDataFrame([(i, [1.0, 2.0], [float(i % 2)]) for i in range(30)], "row_id int, features array<double>, y array<double>")
    forest = T.fit_forest(df, 3, 5, 5)
    got = {tuple(r.pred) for r in T.predict_forest(df, forest).select("pred").collect()}
    assert len(got) == 1 and 0.2 < got.pop()[0] < 0.8
    with pytest.raises(ValueError):
        T.fit_forest(df.limit(0), 3, 5, 5)


def test_features_of_two_bins_are_not_sorted_and_trees_stay_the_same(monkeypatch):
    """Every feature used to be ordered and added up in every node; those of two
    bins now come from a matrix product, and only the best are added up."""
    rng = np.random.default_rng(9)
    for n, min_leaf, depth in ((400, 5, 15), (37, 1, 15), (6, 2, 3), (300, 3, 0)):
        x = np.concatenate([rng.integers(0, 9, (n, 4)), rng.random((n, 30)) < 0.3, rng.random((n, 6)) < 0.02], axis=1).astype(float)
        x = np.concatenate([x, x[:, 5:9], 1 - x[:, 5:9], x[:, :1] * 2, np.ones((n, 1))], axis=1)[:, rng.permutation(50) % 50]
        y = np.stack([x[:, 3] * x[:, 7] + rng.normal(0, 0.1, n), rng.normal(size=n)], axis=1)
        w = rng.integers(1, 4, n).astype(float)
        edges = {f: T.cut_points(np.append(x[:, f], [0.0, 1.0]), 256) for f in range(x.shape[1])}
        bins, seen, best = T.binned(x, edges), [], T._best

        def watched(order, *rest):
            seen.append(len(order))
            return best(order, *rest)

        monkeypatch.setattr(T, "_best", watched)
        tree, gains = T.grow(bins, y, w, depth, min_leaf, edges, x.shape[1])
        monkeypatch.setattr(T, "_best", best)
        assert max(seen, default=0) < 25                     # of 50 features

        # the plain way: all features in every node
        wy, count, want = y * w[:, None], 0, np.zeros(x.shape[1])

        def check(at, rows, level):
            nonlocal count
            count += 1
            total, weight = wy[rows].sum(0), w[rows].sum()
            top = (-np.inf, None, None)
            for f in range(x.shape[1]) if level < depth and len(rows) >= 2 * min_leaf else ():
                for b in np.unique(bins[rows, f])[:-1]:
                    low = rows[bins[rows, f] <= b]
                    if min(len(low), len(rows) - len(low)) < min_leaf:
                        continue
                    s, v = wy[low].sum(0), w[low].sum()
                    gain = (s * s).sum() / v + ((total - s)**2).sum() / (weight - v) - (total * total).sum() / weight
                    if gain > top[0] * (1 + 1e-9) + 1e-12:
                        top = gain, f, b
            assert np.allclose(tree.value[at], total / weight)
            if top[1] is None or top[0] <= 1e-9:
                assert tree.feature[at] == -1 or top[0] > -np.inf
                return
            f = tree.feature[at]
            low = x[rows, f] <= tree.threshold[at]
            s, v = wy[rows[low]].sum(0), w[rows[low]].sum()
            got = (s * s).sum() / v + ((total - s)**2).sum() / (weight - v) - (total * total).sum() / weight
            assert abs(got - top[0]) <= 1e-9 * max(abs(got), 1)
            want[f] += got
            check(tree.left[at], rows[low], level + 1)
            check(tree.right[at], rows[~low], level + 1)

        check(0, np.arange(n), 0)
        assert count == len(tree.feature) and np.allclose(gains, want)
