"""Clustering and silhouette against naive re-computations."""

import numpy as np
import pytest

from sigflow.operators import compounds as CH
from sigflow.operators.compounds import _tanimoto_dense, linkage_clusters, silhouette


def naive_linkage(D, cutoff, method):
    clusters = [[i] for i in range(len(D))]

    def dist(a, b):
        vals = [D[i][j] for i in a for j in b]
        return {"average": np.mean, "complete": np.max, "single": np.min}[method](vals)

    while len(clusters) > 1:
        best = None
        for x in range(len(clusters)):
            for y in range(x + 1, len(clusters)):
                d = dist(clusters[x], clusters[y])
                if best is None or d < best[0]:
                    best = (d, x, y)
        if best[0] > cutoff:
            break
        _, x, y = best
        clusters[x] = clusters[x] + clusters[y]
        del clusters[y]
    return sorted(sorted(c) for c in clusters)


def as_partition(labels):
    out = {}
    for i, c in enumerate(labels):
        out.setdefault(c, []).append(i)
    return sorted(sorted(v) for v in out.values())


def test_known_tree_average_cut():
    # points on a line: 0, 0.1, 1.0, 1.05 ; cut at 0.6
    x = np.array([0.0, 0.1, 1.0, 1.05])
    D = np.abs(x[:, None] - x[None, :])
    assert as_partition(linkage_clusters(D, 0.6, "average")) == [[0, 1], [2, 3]]


def test_random_vs_naive():
    rng = np.random.default_rng(0)
    for method in ("average", "complete", "single"):
        for _ in range(5):
            bits = [sorted(rng.choice(64, size=rng.integers(5, 30), replace=False)) for _ in range(30)]
            D = 1.0 - _tanimoto_dense(bits, 64)
            assert as_partition(linkage_clusters(D, 0.6, method)) == naive_linkage(D, 0.6, method)


def test_silhouette_rules():
    D = np.array([[0, 1, 4], [1, 0, 4], [4, 4, 0]], dtype=float)
    assert silhouette(D, np.array([0, 0, 0])) is None          # one cluster
    assert silhouette(D, np.array([0, 1, 2])) is None          # n clusters
    s = silhouette(D, np.array([0, 0, 1]))                     # singleton scores 0
    a, b = 1.0, 4.0
    assert abs(s - (2 * (b - a) / b + 0.0) / 3) < 1e-12


def test_tanimoto_salted_hot_bit_equals_plain(spark):
    import random

    from sigflow.operators import compounds as CH
    random.seed(1)
    rows = [(i, sorted({0} | set(random.sample(range(1, 200), 5)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, bits array<int>")
    salted = CH.tanimoto_pairs(df, "id", salt_rows=10)      # bit 0 (held by all) split 4 ways
    plain = CH.tanimoto_pairs(df, "id", salt_rows=10 ** 9)
    assert salted.count() == 120 * 119 // 2
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_clusters_by_component_equal_the_whole_group(spark):
    from sigflow.operators import compounds as CH
    rng = np.random.default_rng(4)
    groups = {g: [sorted(rng.choice(24, size=rng.integers(1, 12), replace=False).tolist()) for _ in range(n)]
              for g, n in (("a", 40), ("b", 25), ("one", 1))}
    rows = [(g, i, b) for g, sets in groups.items() for i, b in enumerate(sets)]
    df = spark.createDataFrame(rows, "grp string, id long, bits array<int>")
    for threshold in (None, 0.5):
        got = CH.cluster_groups(df, "id", "grp", n_bits=24, cutoff=0.55, sim_threshold=threshold).collect()
        assert len(got) == len(rows)
        for g, sets in groups.items():
            sim = _tanimoto_dense(sets, 24)
            if threshold:
                sim = np.where(sim < threshold, 0.0, sim)
                np.fill_diagonal(sim, 1.0)
            own = sorted((r.id, r.cluster_id, r.n_clusters, r.silhouette) for r in got if r.grp == g)
            want = linkage_clusters(1 - sim, 0.55)
            assert [r[1] - 1 for r in own] == want.tolist() and own[0][2] == len(set(want.tolist()))
            s = silhouette(1 - sim, want)
            assert own[0][3] is None if s is None else abs(own[0][3] - s) < 1e-9


def test_threshold_at_an_exact_ratio(spark):
    from sigflow.operators import compounds as CH
    df = spark.createDataFrame([(1, list(range(100))), (2, list(range(55)))], "id long, bits array<int>")
    assert CH.tanimoto_pairs(df, "id", threshold=0.55).collect()[0].sim == 0.55


def test_components_of_a_long_path_and_a_hub(spark, monkeypatch):
    from sigflow.operators import components as K
    monkeypatch.setattr(K, "HEAVY_ROWS", 50)
    edges = [(i, i + 1) for i in range(400)] + [(1000, 1001 + i) for i in range(200)]
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = df.select(df.a.alias("id")).union(df.select("b"))
    got = {r.id: r.component for r in K.connected_components(nodes, df).collect()}
    assert all(got[i] == 0 for i in range(401)) and all(got[1000 + i] == 1000 for i in range(201))


@pytest.mark.parametrize("rows", [4096, 7])
def test_silhouette_in_blocks(spark, monkeypatch, rows):
    """Blocks smaller than the largest clusters, against the distance matrix."""
    from sigflow.operators import compounds as C
    monkeypatch.setattr(C, "SILHOUETTE_ROWS", rows)
    rng = np.random.default_rng(7)
    data = [(g, i, sorted(int(x) for x in rng.choice(40, size=rng.integers(0, 20), replace=False)), int(rng.integers(0, 4)) if i > 12 else 0)
            for g in ("a", "b") for i in range(40)] + [("c", 1, [1], 0), ("c", 2, [2], 0)]
    df = spark.createDataFrame(data, "g string, k int, bits array<int>, lab int")
    got = {r.g: r.silhouette for r in C.silhouette_groups(df, "k", "g", "lab").collect()}
    assert got["c"] is None
    for g in ("a", "b"):
        mine = [d for d in data if d[0] == g]
        want = silhouette(1.0 - _tanimoto_dense([d[2] for d in mine], 40), np.array([d[3] for d in mine]))
        assert abs(got[g] - want) < 1e-6


@pytest.mark.parametrize("threshold", [0.0, 0.4])
def test_tanimoto_blocks_equal_the_index(spark, threshold):
    """Blocks of 7 rows against the index, with copies, NULLs and empty sets."""
    from sigflow.operators import compounds as CH
    rng = np.random.default_rng(11)
    rows = [(g, int(i), sorted(rng.choice(20, size=rng.integers(0, 15), replace=False).tolist()))
            for g in ("a", "b") for i in rng.permutation(40)] + [(None, 1, [1]), ("a", None, [1, 2]), ("b", 99, None)]
    df = spark.createDataFrame(rows, "grp string, id long, bits array<int>")
    index = CH.tanimoto_pairs(df, "id", threshold=threshold, group_cols=["grp"], block_rows=0)
    blocks = CH.tanimoto_pairs(df, "id", threshold=threshold, group_cols=["grp"], block_rows=7)
    assert blocks.schema.simpleString() == index.schema.simpleString()
    assert sorted(blocks.collect()) == sorted(index.collect()) and blocks.count() > (50 if threshold else 500)
    one = CH.tanimoto_pairs(df, "id", threshold=threshold, block_rows=7)
    assert CH.tanimoto_pairs(df.limit(0), "id", threshold=threshold).count() == 0
    # a row that stands twice gives what the index gives
    twice = df.where("id < 9").unionByName(df.where("id < 3"))
    a, b = (CH.tanimoto_pairs(twice, "id", threshold=threshold, group_cols=["grp"], block_rows=r) for r in (5, 0))
    cols = ["grp", "a", "b", "inter"]
    assert sorted(a.select(*cols).collect()) == sorted(b.select(*cols).collect())
    carried = CH.tanimoto_pairs(df.where("id < 30").withColumn("c", df.id % 3), "id", threshold=threshold, block_rows=7, carry=["c"])
    assert all(r.a_c == r.a % 3 and r.b_c == r.b % 3 for r in carried.collect()) and one.count() > blocks.count()


def test_few_links_keep_components(spark):
    """With ``forest`` the links of 300 equal sets are no longer all pairs."""
    from sigflow.operators import compounds as CH
    from sigflow.operators.components import connected_components
    rng = np.random.default_rng(12)
    rows = [(i, [1, 2, 3]) for i in range(300)] + [(300 + i, sorted(rng.choice(60, size=4, replace=False).tolist())) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, bits array<int>")
    every = CH.tanimoto_pairs(df, "id", threshold=0.4)
    few = CH.tanimoto_pairs(df, "id", threshold=0.4, block_rows=100, forest=True)
    assert every.count() > 300 * 299 // 2 and few.count() < 2 * 500 * 6
    want = sorted(connected_components(df, every).select("id", "component").collect())
    assert sorted(connected_components(df, few).select("id", "component").collect()) == want


def test_average_linkage_without_a_matrix():
    """A component of 60,000 rows needed a matrix of 29 GB; here sums are made
    from the rows when needed, whatever fits the memory."""
    rng = np.random.default_rng(5)
    for n, cutoff, low, held in ((90, 0.6, None, 1 << 20), (140, 0.7, 0.35, 4000), (60, 0.99, None, 0), (1, 0.6, None, 0)):
        centre = rng.random((9, 700)) < 0.3
        rows = [np.flatnonzero(centre[k % 9] ^ (rng.random(700) < 0.12 * rng.random())) for k in range(n)]
        sim = CH._tanimoto_dense(rows, 700)
        if low is not None:
            sim[sim < low] = 0.0
        old, CH.LINKAGE_BYTES = CH.LINKAGE_BYTES, held
        try:
            got = CH.average_linkage(rows, 700, cutoff, low)
        finally:
            CH.LINKAGE_BYTES = old
        assert got.tolist() == CH.linkage_clusters(1.0 - sim, cutoff).tolist()


def test_clusters_are_the_same_without_a_matrix(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.random((4, 300)) < 0.3
    rows = [(i, i % 2, np.flatnonzero(centre[i % 4] ^ (rng.random(300) < 0.05)).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, moa int, bits array<int>")
    rows = lambda: sorted((r.id, r.moa, r.cluster_id, r.n_clusters, round(r.silhouette, 9))
                          for r in CH.cluster_groups(df, "id", "moa", cutoff=0.7).collect())
    want = rows()
    monkeypatch.setattr(CH, "linkage_clusters", None)         # a matrix would be needed
    monkeypatch.setattr(CH, "LINKAGE_ROWS", 1)
    assert rows() == want


def test_pairs_are_added_up_by_label_where_they_are_made(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i % 50), "g", int(i % 50 % 6), float(1 + i % 50 % 3), sorted(rng.choice(20, 6, replace=False).tolist()))
            for i in range(70)]                                # keys that stand twice
    df = spark.createDataFrame(rows, "id long, grp string, lab int, w double, bits array<int>")
    pairs = CH.tanimoto_pairs(df, "id", group_cols=["grp"], block_rows=0, carry=["lab", "w"]).collect()
    want = {}
    for p in pairs:
        if p.a_lab != p.b_lab:
            at = (p.grp, min(p.a_lab, p.b_lab), max(p.a_lab, p.b_lab))
            want[at] = want.get(at, 0) + p.sim * p.a_w * p.b_w
    for block_rows in (0, 1000, 12, 5):                        # by the index, in one block, labels whole, labels cut
        got = CH.tanimoto_pairs(df, "id", group_cols=["grp"], block_rows=block_rows, carry=["lab", "w"], sum_by=("lab", "w"))
        got = {(r.grp, r.x, r.y): r.s for r in got.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_a_block_is_shipped_as_bits(spark):
    """Rows of lists used to go to every block they meet."""
    df = spark.range(64).selectExpr("id", "filter(sequence(0, 63), i -> (id * (i + 3)) % 7 < 3) AS bits")
    plan = CH.tanimoto_pairs(df, "id", block_rows=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "_cells" in plan
    text = [(r.id, [f"b{x}" for x in r.bits]) for r in df.collect()]
    text = CH.tanimoto_pairs(spark.createDataFrame(text, "id long, bits array<string>"), "id", block_rows=8, threshold=0.4)
    plain = CH.tanimoto_pairs(df, "id", block_rows=0, threshold=0.4)
    assert sorted(text.collect()) == sorted(plain.collect()) and plain.count()
