"""Hits-only enrichment walk and kernel CDF against naive versions."""

import math

import numpy as np

from sigflow.operators import enrich as E


def naive_es(v, members, p=1.0):
    order = np.argsort(-v, kind="stable")
    hit = np.isin(order, members)
    w = np.abs(v[order]) ** p
    W = w[hit].sum()
    N, H = len(v), hit.sum()
    run, best_hi, best_lo = 0.0, -np.inf, np.inf
    vals = [0.0]
    for k in range(N):
        run += (w[k] / W) if hit[k] else -1.0 / (N - H)
        vals.append(run)
    hi, lo = max(vals), min(vals)
    return hi if abs(hi) > abs(lo) else lo


def test_closed_form_matches_walk():
    rng = np.random.default_rng(1)
    mat = rng.normal(size=(40, 50))
    members = {0: np.array(sorted(rng.choice(50, 12, replace=False)))}
    for sid, es, H in E._es_block(mat, members, 1.0, 1, 500):
        for r in range(len(mat)):
            want = naive_es(mat[r], members[sid])
            # the walk's extremes include the start (0); the closed form only
            # differs when 0 itself is the extreme, where both give 0 or the same sign
            if abs(want) > 1e-12:
                assert abs(es[r] - want) < 1e-12


def test_gaussian_kernel_cdf(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(7, 3))          # 7 samples x 3 genes
    rows = [(f"s{i}", f"g{j}", float(x[i, j])) for i in range(7) for j in range(3)]
    df = spark.createDataFrame(rows, "sample string, gene string, value double")
    got = {(r.sample, r.gene): r.cdf for r in E.kernel_cdf(df, "sample", "gene", "value", part_rows=3).collect()}
    for j in range(3):
        h = np.std(x[:, j], ddof=1) / 4
        for i in range(7):
            want = np.mean([0.5 * (1 + math.erf((x[i, j] - x[k, j]) / h / math.sqrt(2))) for k in range(7)])
            assert abs(got[(f"s{i}", f"g{j}")] - want) < 1e-12


def test_poisson_cdf_exact():
    k = np.array([0, 1, 3])
    lam = np.array([0.5, 2.5])
    got = E._poisson_cdf(k, lam)
    for a, kk in enumerate(k):
        for b, l_ in enumerate(lam):
            want = sum(math.exp(-l_) * l_ ** i / math.factorial(i) for i in range(kk + 1))
            assert abs(got[a, b] - want) < 1e-12


def test_poisson_cells_do_not_depend_on_their_block():
    from math import erf, fsum, lgamma, log
    from sigflow.operators.enrich import _erf, _poisson_cdf
    alone = _poisson_cdf(np.array([3.0]), np.array([3.5, 9.5]))
    assert np.array_equal(_poisson_cdf(np.array([3.0, 2001.0]), np.array([3.5, 9.5]))[0], alone[0])
    assert np.allclose(alone, [[0.5366326679, 0.0148595]], atol=1e-6)
    for k in (10, 299, 300, 301, 2000, 20000):
        i = np.arange(k + 1)
        lg = np.array([lgamma(v + 1.0) for v in i])
        for lam in (0.5 * k, 0.97 * k, k + 0.5, 1.05 * k, 2.0 * k):
            want = fsum(np.exp(-lam + i * log(lam) - lg))
            assert abs(_poisson_cdf(np.array([float(k)]), np.array([lam]))[0, 0] - want) < 1e-9
    x = np.linspace(-7, 7, 5001)
    assert np.abs(_erf(x) - [erf(v) for v in x]).max() < 1e-15


def test_large_collections_are_dealt_into_parts(spark, monkeypatch):
    from sigflow.operators import enrich as E
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=30).tolist()) for i in range(4)], "sig_id long, features array<double>")
    mem = spark.createDataFrame([(s, int(g)) for s in range(12) for g in rng.choice(30, 6, replace=False)],
                                "pathway_id long, gene long")
    whole = sorted(map(repr, E.enrichment_vectors(df, mem, min_size=2).collect()))
    monkeypatch.setattr(E, "MEMBERSHIP_ROWS", 20)
    assert sorted(map(repr, E.enrichment_vectors(df, mem, min_size=2).collect())) == whole


def test_set_size_counts_distinct_members_of_the_matrix(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3, 40))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "sig_id long, features array<double>")
    rows = [(1, g) for g in range(5, 100)] + [(2, 7), (2, 9), (2, 11)] * 30 + [(3, g) for g in range(38)] + [(4, 3), (4, 8)]
    mem = spark.createDataFrame(rows, "pathway_id long, gene long")
    long = spark.createDataFrame([(i, g, float(x)) for i, v in enumerate(vectors) for g, x in enumerate(v)],
                                 "sig_id long, gene long, v double")
    want = {(r[0], r[1]): (r.es, r.n_hits) for r in E.prerank_long(long, mem.distinct(), min_size=2, max_size=36).collect()}
    assert {k[1] for k in want} == {1, 2, 4}                 # set 1 has 95 members, 35 in the matrix; set 3 has 38
    for limit in (E.MEMBERSHIP_ROWS, 20):
        monkeypatch.setattr(E, "MEMBERSHIP_ROWS", limit)
        got = {(r[0], r[1]): (r.es, r.n_hits) for r in E.enrichment_vectors(df, mem, min_size=2, max_size=36).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-12 for k in want)


def test_cell_sums_equal_plain_sums():
    rng = np.random.default_rng(9)

    def moments(cell, off):
        index, back = np.unique(cell, return_inverse=True)
        m = np.zeros((len(index), E.TERMS + 1))
        for j in range(E.TERMS + 1):
            np.add.at(m[:, j], back, off ** j)
        return index, m

    for x in (rng.normal(size=3000) * 4, np.concatenate([rng.normal(size=500), [400.0, -900.0]]), rng.integers(0, 9, 400) * 1.0):
        cell = np.floor(x * E.GAUSS_CELLS)
        index, m = moments(cell, x - (cell + 0.5) / E.GAUSS_CELLS)
        want = E._norm_cdf(x[:, None] - x[None]).mean(axis=1)
        assert np.abs(E._gauss_sums(x, index, m) / len(x) - want).max() < 1e-12
    for x in (rng.poisson(3, 500) * 1.0, rng.gamma(1.0, 400.0, 2000), rng.gamma(0.3, 1e5, 1500), np.array([0.0, 0.0, 299.0, 300.0, 301.5])):
        lam = x + 0.5
        cell = np.floor(np.sqrt(lam) * E.ROOT_CELLS)
        root = (cell + 0.5) / E.ROOT_CELLS
        index, m = moments(cell, (lam - root * root) / (root / E.ROOT_CELLS))
        k = np.unique(np.floor(x))
        want = E._poisson_cdf(k, lam).mean(axis=1)
        assert np.abs(E._poisson_sums(k, index, m) / len(x) - want).max() < 1e-10, np.abs(E._poisson_sums(k, index, m) / len(x) - want).max()


def test_kernel_cdf_poisson_parts_and_odd_values(spark):
    rng = np.random.default_rng(10)
    x = rng.gamma(0.5, 900.0, 60)
    rows = [(i, "a", float(v)) for i, v in enumerate(x)] + [(i, "const", 2.0) for i in range(5)]
    rows += [(i, "nan", v) for i, v in enumerate([1.0, float("nan"), 3.0])] + [(i, "null", v) for i, v in enumerate([1.0, None, 3.0])]
    df = spark.createDataFrame(rows, "sample long, gene string, value double")
    got = {(r.sample, r.gene): r.cdf for r in E.kernel_cdf(df, "sample", "gene", "value", "poisson", part_rows=11).collect()}
    assert {g for _, g in got} == {"a", "null"} and len(got) == 62
    want = E._poisson_cdf(x, x + 0.5).mean(axis=1)
    assert max(abs(got[(i, "a")] - want[i]) for i in range(60)) < 1e-10
