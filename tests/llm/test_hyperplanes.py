import numpy as np
import pytest

from sigflow.llm import hyperplanes as H
from sigflow.llm.simhash import union


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.9):
    """(n_links, component_id, kept) of every row, all pairs."""
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = rows[i][1], rows[j][1]
            if i != j and good(a) and good(b) and len(a) == len(b):
                a, b = np.float64(a), np.float64(b)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                near[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold
    label = union(np.arange(n), *np.nonzero(near))
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in np.flatnonzero(label == label[i]) if rows[j][0] is not None]
        lead = min(ids, default=None)
        out.append((rows[i][0], int(near[i].sum()), lead, rows[i][0] == lead))
    return sorted(out, key=str)


def found(spark, rows, parts, kind="float", **more):
    df = spark.createDataFrame([(*r, 5) for r in rows], f"vec_id long, embedding array<{kind}>, n_links int").repartition(parts)
    return sorted(map(tuple, H.near_vectors(df, **more).collect()), key=str)


def edge_rows(rng, n, d=16, groups=12, spread=0.06):
    """Groups of near copies whose cosines keep away from the threshold."""
    centre = rng.normal(size=(groups, d))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    v = centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d)) / np.sqrt(d)
    rows = [(i, np.float32(x).tolist()) for i, x in enumerate(v)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(3, rows[3][1]), (None, rows[3][1]), (None, rng.normal(size=d).tolist())]
    rows += [(2000, None), (2001, []), (2002, [0.0] * d), (2003, [float("nan")] * d), (2004, [float("inf")] + [1.0] * (d - 1)),
             (2005, [None] * d), (2006, [1.0] * 3), (2007, [2.0] * 3), (2008, [-1.0] * 3), (2009, [-0.0, 1.0, 0.0]), (2010, [0.0, 1.0, -0.0])]
    return rows


@pytest.mark.parametrize("parts, part, tile, bucket", [(1, 1 << 14, 1024, 1024), (4, 50, 16, 64), (8, 20, 7, 8)])
def test_equals_brute_force(spark, monkeypatch, parts, part, tile, bucket):
    """Small buckets, parts and tiles: several tables, hot buckets split."""
    monkeypatch.setattr(H, "PART", part)
    monkeypatch.setattr(H, "TILE", tile)
    monkeypatch.setattr(H, "BUCKET", bucket)
    rows = edge_rows(np.random.default_rng(parts), 300)
    assert found(spark, rows, parts, recall=0.9999) == brute(rows)


def test_large_components_double_values_and_none(spark):
    rows = [(100 - i, [float(1e300 * np.cos(i / 3)), float(1e300 * np.sin(i / 3))]) for i in range(60)]       # a chain around the circle
    assert found(spark, rows, 3, "double", recall=0.99999) == brute(rows)
    assert found(spark, [], 1) == []
    assert found(spark, [(5, None), (None, None)], 1) == sorted([(5, 0, 5, True), (None, 0, None, True)], key=str)


def test_star_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(7, 7)] + \
        [tuple(int(x) for x in p) for p in rng.integers(200, 400, (120, 2))]
    got = {r.node: r.component for r in H.star_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = union(np.arange(401), *np.array(pairs).T)
    want = {int(x): int(label[x]) for p in pairs for x in p if p[0] != p[1]}
    assert got == want


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_driver_tables(spark, monkeypatch, sf):
    """Links found of all by brute force; buckets small enough for several tables."""
    monkeypatch.setattr(H, "BUCKET", 64)
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").toPandas()
    x = H.unit(np.vstack(df.embedding))
    all_links = (x @ x.T >= 0.9).sum(1) - 1
    out = H.near_vectors(spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")).toPandas().set_index("vec_id")
    got = out.loc[df.vec_id, "n_links"].to_numpy()
    assert (got <= all_links).all() and got.sum() >= 0.97 * all_links.sum()
