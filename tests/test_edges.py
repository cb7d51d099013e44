"""Edge cases of FIXTURES part C."""

from sigflow.operators import annotate as A
from sigflow.operators import correlations as C
from sigflow.operators import tables as TB


def test_null_first_duplicate_key_is_kept(spark):
    df = spark.createDataFrame([(1, None, 0), (1, "x", 1), (2, "y", 2), (2, None, 3)], "k long, v string, _ord long")
    assert {(r.k, r.v) for r in TB.keep_first(df, ["k"]).collect()} == {(1, None), (2, "y")}
    comp = spark.createDataFrame([(1, None, "t", 0), (1, "m", "u", 1)], "pert_id long, moa string, target string, _ord long")
    assert A.first_compound_row(comp).collect()[0].moa is None


def test_constant_vector_and_single_member_label(spark):
    rows = [(0, [1.0, 1.0, 1.0], 0, "a"), (1, [1.0, 2.0, 3.0], 0, "a"), (2, [3.0, 1.0, 2.0], 0, "b"),
            (3, [0.0, 1.0, 5.0], 0, None), (4, [2.0, 4.0, 6.0], 0, "a")]
    df = spark.createDataFrame(rows, "id long, v array<double>, cell int, lab string")
    got = C.pair_correlations(df, "id", "v", "cell", "lab", "pearson", 50).collect()
    intra = {frozenset((r.a_id, r.b_id)): r.r for r in got if r.kind == "intra"}
    assert set(intra) == {frozenset(p) for p in ((0, 1), (0, 4), (1, 4))}      # b has one member, NULL none
    assert intra[frozenset((0, 1))] is None and abs(intra[frozenset((1, 4))] - 1) < 1e-9
    assert sum(r.kind == "inter" for r in got) == 3


def test_null_feature_mask_of_ragged_rows(spark):
    from sigflow.operators.tables import drop_null_features, null_feature_mask
    nan = float("nan")
    rows = [([1.0, None, 3.0, 4.0],), ([1.0, 2.0, nan, 4.0],), (None,), ([],), ([1.0, 2.0],), ([0.0, 0.0, 0.0, 0.0, 5.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    for parts in (1, 4):
        assert null_feature_mask(df.repartition(parts), "v").first()[0] == [True, False, False, True, True]
    assert null_feature_mask(df.limit(0), "v").first()[0] == []
    full = spark.createDataFrame([r for r in rows[:2]], "v array<float>")
    assert sorted(r.v for r in drop_null_features(full, "v").collect()) == [[1.0, 4.0], [1.0, 4.0]]


def test_ngram_bits_against_one_hash_a_gram(spark):
    import hashlib

    from sigflow.operators.compounds import ngram_bits
    texts = ["CCO", "CCOCCOCCO", "", None, "ab", "éééé", "CCOCCOCCO"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.b for r in df.select("i", ngram_bits("t", 3, 64).alias("b")).collect()}
    for i, t in enumerate(texts):
        grams = [t[k:k + 3] for k in range(len(t) - 2)] if t else []
        assert got[i] == sorted({int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 64 for g in grams})


def test_ngram_bits_hold_one_string_and_a_bounded_table(monkeypatch):
    import hashlib
    import random
    import tracemalloc

    import pandas as pd

    from sigflow.operators import compounds as CH
    rng = random.Random(1)
    texts = pd.Series(["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2000)) for _ in range(300)] + [None, "ab"])
    monkeypatch.setattr(CH, "HASHED_GRAMS", 5000)
    tracemalloc.start()
    got = CH._hashed_bits(texts, 5, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6                       # the n-grams of all strings take over 40 MB
    for i in (0, 150, 299):
        grams = {texts[i][k:k + 5] for k in range(1996)}
        assert list(got[i]) == sorted({int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 64 for g in grams})
    assert [list(b) for b in got[-2:]] == [[], []]


def test_dense_bits_hold_one_copy_of_a_batch(spark):
    import tracemalloc

    import numpy as np
    import pandas as pd

    from sigflow.operators import ml as M
    from sigflow.operators.compounds import dense_bits
    df = spark.createDataFrame([(1, [0, 3]), (2, None), (3, []), (4, [4])], "i int, b array<int>")
    got = {r.i: r.v for r in df.coalesce(1).select("i", dense_bits("b", 5).alias("v")).collect()}
    assert got == {1: [1.0, 0, 0, 1, 0], 2: [0.0] * 5, 3: [0.0] * 5, 4: [0, 0, 0, 0, 1.0]}
    rng = np.random.default_rng(0)
    X, Y = rng.normal(size=(5000, 400)), rng.normal(size=(5000, 2))
    pdf = pd.DataFrame({"x": list(X), "y": list(Y)})
    tracemalloc.start()
    total = sum(x.T @ np.hstack([x, y]) for x, y in M._slices(pdf, "x", "y"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < X.nbytes / 2 and np.allclose(total, X.T @ np.hstack([X, Y]))
