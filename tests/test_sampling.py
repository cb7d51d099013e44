"""Deterministic pair draws and skew-safe numbering."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sigflow.operators.sampling import dense_index, hash_cuts, md5_hex, sample_pairs


def test_pairs_distinct_capped_complete(spark):
    groups = spark.createDataFrame([(g, n) for g, n in enumerate([1, 2, 3, 5, 11, 40])], "g int, n int")
    pairs = sample_pairs(groups, ["g"], "n", 50, 42).collect()
    by = {}
    for r in pairs:
        assert 0 <= r._i < r._j
        by.setdefault(r.g, set()).add((r._i, r._j))
    sizes = {g: n for g, n in enumerate([1, 2, 3, 5, 11, 40])}
    for g, n in sizes.items():
        c = n * (n - 1) // 2
        got = by.get(g, set())
        assert len(got) == min(c, 50)                 # distinct, capped
        assert all(j < n for _, j in got)
        if c <= 50:
            assert got == {(i, j) for j in range(n) for i in range(j)}   # all pairs when few


def test_dense_index_equals_row_number(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("k"))
    df = df.withColumn("_h", md5_hex(7, "id"))
    got = dense_index(df, ["k"], "_h", "id").select("id", "_idx")
    w = Window.partitionBy("k").orderBy("_h", "id")
    want = df.select("id", (F.row_number().over(w) - 1).alias("_idx"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_shared_draws_equal_separate_runs(spark):
    from conftest import SF001
    from sigflow.operators import correlations as C
    from sigflow.plans import q_correlations as Q
    from sigflow.sources import proxies as px
    study = Q._study(spark, SF001).where("matrix = 'raw' AND cor_type = 'spearman'").drop("matrix", "cor_type")
    alone = C.pair_correlations(px.signatures(spark, SF001), "sig_id", "features", "cell", "moa",
                                "spearman", Q.MAX_PAIRS, Q.SEED)
    assert study.exceptAll(alone).count() == 0 and alone.exceptAll(study).count() == 0


def test_every_pair_is_equally_likely(spark):
    # 8 of 28 pairs (sorted numbers) and 3 of 45 (drawn numbers), over many seeds
    from collections import Counter
    for n, cap in ((8, 8), (10, 3)):
        groups = spark.createDataFrame([(g, n) for g in range(1500)], "g int, n int")
        count = Counter((r._i, r._j) for r in sample_pairs(groups, ["g"], "n", cap, 1).collect())
        c = n * (n - 1) // 2
        want = 1500 * cap / c
        assert len(count) == c and all(abs(v - want) < 6 * want ** 0.5 for v in count.values())


def test_hash_cuts_count_the_values_below(spark):
    df = spark.range(3000).select(md5_hex(7, "id").alias("_h"))
    values = sorted(r[0] for r in df.collect())
    ranks = [0, 1, 17, 1500, 2999, 3000]
    for rows, distinct in ((df, False), (df.unionAll(df), True)):
        cuts = hash_cuts(rows, "_h", lambda n: ranks if n == 3000 else None, distinct)
        assert [sum(v < c for v in values) for c in cuts] == ranks
    hot = df.limit(10).unionAll(spark.range(90).select(F.lit("7" * 32).alias("_h")))     # a run of equal values
    values = sorted(r[0] for r in hot.collect())
    below = [sum(v < c for v in values) for c in hash_cuts(hot, "_h", lambda n: [0, 50, n])]
    assert below == [0, values.index("7" * 32), 100]
    assert hash_cuts(df.limit(0), "_h", lambda n: [0]) == ["g"]
