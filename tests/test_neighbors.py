"""Exact k-NN under ties and other edge cases."""

import numpy as np
import pytest

from sigflow.operators import neighbors as N


@pytest.mark.parametrize("partitions, block_rows", [(1, 2048), (8, 2048), (8, 7)])
def test_identical_vectors_are_ordered_by_id(spark, partitions, block_rows):
    rows = [(i, [1.0, 2.0, 3.0], "a" if i < 25 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>, lab string").repartition(partitions)
    got = N.knn(df, "id", "v", 5, scale=False, block_rows=block_rows)
    assert {(r.q_id, r.rank): r.c_id for r in got.collect()} == {(q, r + 1): r for q in range(40) for r in range(5)}
    purity = {r.id: r.nn_purity for r in N.neighbor_purity(df, "id", "v", "lab", 5, scale=False).collect()}
    assert all(purity[i] == (1.0 if i < 25 else 0.0) for i in range(40))


def test_against_brute_force_with_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 6)).round(1)
    x = np.vstack([base, base[:20], base[:20] + 1e-9])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in N.knn(df, "id", "v", 4, scale=False, block_rows=11).collect():
        got.setdefault(r.q_id, {})[r.rank] = r.c_id
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        assert [got[i][r] for r in (1, 2, 3, 4)] == np.lexsort((np.arange(len(x)), d[i]))[:4].tolist()


def test_fewer_rows_than_k_and_constant_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    assert N.knn(df, "id", "v", 5).count() == 4


def _clusters(seed, n, dims, centres):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims)) * 20
    x = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dims))
    x[n // 2: n // 2 + n // 3] = x[0]                    # a third of all rows are copies of one
    return x


def test_pivot_index_equals_brute_force_in_groups(spark):
    x = _clusters(5, 600, 4, 12)
    lab = [None if i % 7 == 0 else f"c{i % 3}" for i in range(len(x))]
    big = np.arange(len(x)) % 5 != 0
    rows = [(int(big[i]), i, v.tolist(), lab[i]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>, lab string")
    got = N.knn(df, "id", "v", 4, ["g"], carry=["lab"], scale=False, block_rows=40).collect()
    assert len(got) == 4 * len(x)
    seen = {}
    for r in got:
        assert r.q_lab == lab[r.q_id] and r.c_lab == lab[r.c_id]
        seen.setdefault(r.q_id, {})[r.rank] = r.c_id
    ids = np.arange(len(x))
    for i in ids:
        mine = ids[big == big[i]]
        d = np.sqrt(np.square(x[mine] - x[i]).sum(axis=1))
        assert [seen[i][r] for r in (1, 2, 3, 4)] == mine[np.lexsort((mine, d))[:4]].tolist()


def test_pivot_index_ships_few_rows(spark):
    from pyspark.sql import functions as F
    x = _clusters(6, 2000, 4, 40)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, _v array<double>")
    blocks = 2000 // 50
    tiles = N.indexed_tiles(df.withColumn("_nb", F.lit(blocks)).withColumn("_asks", F.lit(True)), "id", 5, [], [], 50)
    queries, rows = tiles.where("_role = 0").count(), tiles.where("_role = 1").count()
    # a copy of every row for every block would be 40 of each
    assert queries < 12 * len(x) and rows < 6 * len(x), (queries, rows)


def test_copies_are_compared_once(spark):
    """Copies ask once: the null labels and ids of each copy stay its own."""
    rows = [(i, [float(i % 3), 1.0], i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>, own long")
    got = N.knn(df, "id", "v", 3, carry=["own"], scale=False, block_rows=20).collect()
    assert len(got) == 900
    assert all(r.q_own == r.q_id and r.c_own == r.c_id and r.dist == 0 and r.c_id == r.q_id % 3 + 3 * (r["rank"] - 1) for r in got)


def test_blocks_grow_before_their_number(spark, monkeypatch):
    """Without structure every row meets every block: a row for each of 4 blocks
    of 100 rows, not of 20 blocks of 20."""
    monkeypatch.setattr(N, "BLOCKS", 4)
    sizes, real = [], N.indexed_tiles
    monkeypatch.setattr(N, "indexed_tiles", lambda *a: sizes.append(real(*a)) or sizes[-1])
    x = np.random.default_rng(2).normal(size=(400, 20))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in N.knn(df, "id", "v", 3, scale=False, block_rows=20).collect():
        got.setdefault(r.q_id, {})[r.rank] = r.c_id
    assert sizes[0].where("_role = 0").count() <= 8 * 400
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        assert [got[i][r] for r in (1, 2, 3)] == np.lexsort((np.arange(len(x)), d[i]))[:3].tolist()


def test_class_statistics_read_the_samples_once(spark):
    from pyspark.sql import functions as F
    runs = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: runs.add(1) or v, "double")
    rows = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("b", 0.0)], "lab string, p double")
    got = N.class_purity_stats(rows.select("lab", seen("p").alias("nn_purity")), "lab").collect()
    assert {r.lab: (r["mean"], r["count"]) for r in got} == {"a": (0.75, 2), "b": (0.0, 1)}
    assert runs.value == 3


def test_block_sizes_stay_bounded(spark):
    from pyspark.sql import functions as F
    x = _clusters(7, 1500, 3, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, _v array<double>")
    base = df.withColumn("_nb", F.lit(30))
    blocks = N._blocked(N._measured(base, [], "id"), [], "id", 50).groupBy("_b").count().collect()
    assert max(r["count"] for r in blocks) <= 200 and sum(r["count"] for r in blocks) == 1500


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert N.knn(df, "id", "v", 5).count() == 0
