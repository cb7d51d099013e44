import numpy as np
import pytest

from sigflow.llm import topk as T


def brute(rows, asked, k):
    out = []
    for q, code in asked:
        near = sorted((bin((code ^ c) & (2**64 - 1)).count("1"), i is not None, i or 0) for i, c in rows)[:k]
        out += [(q, r + 1, i if has else None, d) for r, (d, has, i) in enumerate(near)]
    return sorted(map(repr, out))


def test_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(-2**63, 2**63 - 1, 60)]
    near = [b ^ (1 << int(rng.integers(0, 63))) for b in base[:20] for _ in range(3)]
    rows = list(enumerate(base + near + [base[0]] * 40)) + [(None, base[1]), (5, base[5]), (7, 0)]
    df = spark.createDataFrame([(i, c, "x") for i, c in rows], "id long, code long, query string")
    asked = [r for r in rows if r[0] is not None and r[0] % 9 == 0]
    queries = spark.createDataFrame(asked, "id long, code long")
    for k in (1, 7):
        got = T.top_k(df, queries, k).collect()
        assert sorted(repr(tuple(r)) for r in got) == brute(rows, asked, k)


def test_tied_codes_with_interleaved_ids(spark):
    # both codes are one bit from the query; the first has the smallest id, the second the next ones
    rows = [(1, 1)] + [(i, 1) for i in range(100, 200, 2)] + [(2, 2)] + [(i, 2) for i in range(101, 200, 2)] + \
        [(3, 7)] + [(4, 2**40 | 2**20)]
    df = spark.createDataFrame(rows, "id long, code long")
    for k in (1, 2, 10):
        got = T.top_k(df, spark.createDataFrame([(0, 0)], "id long, code long"), k).collect()
        assert sorted(repr(tuple(r)) for r in got) == brute(rows, [(0, 0)], k)


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 5), (2, -1)], "id long, code long")
    got = T.top_k(df, df, 10).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute([(1, 5), (2, -1)], [(1, 5), (2, -1)], 10)
    assert T.top_k(df.limit(0), df.limit(0), 3).collect() == []


def test_sign_code(spark):
    df = spark.createDataFrame([([1.0, -1.0, None, 2.0],), (None,), ([],)], "v array<double>")
    assert [r[0] for r in df.select(T.sign_code("v")).collect()] == [9, 0, 0]
    assert sum(w for _, w in T.segments(10**6)) == 64


def test_longer_vectors_fail(spark):
    df = spark.createDataFrame([([0.0] * 64 + [1.0] * 6,)], "v array<double>")
    with pytest.raises(Exception, match="at most 64"):
        df.select(T.sign_code("v")).collect()
