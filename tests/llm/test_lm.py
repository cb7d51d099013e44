import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigflow.llm import lm as M
from sigflow.llm.common import crc32_mod


def docs():
    rng = np.random.default_rng(8)
    words = [f"w{int(i)}" for i in range(80)]
    rows = [(i, " ".join(words[int(min(79, rng.geometric(.06)))] for _ in range(rng.integers(0, 60)))) for i in range(120)]
    return rows + [(120, None), (121, ""), (122, " \t"), (123, "Ab aB é É"), (None, "w1 w2"), (5, rows[5][1]), (124, "w3 " * 20000)]


def test_base_against_brute_force(spark):
    rows = docs()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            count.update((t or "").encode().lower().split())
            ends += 1
    total, size = sum(count.values()) + ends, len(count) + 1
    for most in (0, 30, 10_000):                      # none, some and all words broadcast
        got = M.lm_scores(df, crc32_mod("doc_id", 10) == 0, rounds=1, most=most).collect()
        want = []
        for i, t in rows:
            w = (t or "").encode().lower().split()
            base = sum(math.log10((c + .1) / (total + .1 * (size + 1))) for c in [*(count[x] for x in w), ends])
            want.append((i, held(i), len(w) + 1, sum(count[x] > 0 for x in w) + 1, total, round(base, 6)))
        have = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
        assert sorted(map(repr, want)) == sorted(map(repr, have))
        assert all(r.score < 0 for r in got)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(9)
    w = rng.normal(0, .1, (3, M.BUCKETS, M.CLASSES + 1))
    label, feats = rng.integers(0, M.CLASSES + 1, 500), rng.integers(0, 4, (3, 500)).astype(np.int16)
    value = lambda w: M.log_softmax(w, feats, label).sum()
    out = np.zeros((3, M.BUCKETS, M.CLASSES + 2))
    M.add_gradient(w, label, feats, out)
    for k, f, c in ((0, 1, 2), (1, 3, 30), (2, 0, 32)):
        up = w.copy()
        up[k, f, c] += 1e-5
        assert out[k, f, c] == pytest.approx((value(up) - value(w)) / 1e-5, abs=1e-2)
        assert out[k, f, -1] == (feats[k] == f).sum()


def test_training_helps_and_probabilities_sum_to_one(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = crc32_mod("doc_id", 10) == 0
    score = lambda rounds: M.lm_scores(df, held, rounds=rounds).where("held_out").agg(F.sum("score")).first()[0]
    assert score(3) > score(0)
    for size in (1, 80):                              # also where exponentials alone would overflow
        w = np.random.default_rng(1).normal(0, size, (3, M.BUCKETS, M.CLASSES + 1))
        every = M.log_softmax(w, np.zeros((3, M.CLASSES + 1), np.int16), np.arange(M.CLASSES + 1))
        assert np.isclose(np.exp(every).sum(), 1)


def test_no_training_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = M.lm_scores(df, F.lit(True)).collect()
    assert got[0].n_known == 0 and got[0].train_tokens == 0 and abs(got[0].base_score) < 1e-9
    assert M.lm_scores(df.limit(0), F.lit(False)).collect() == []


def _plain_pairs(rows, held, variance=M.VARIANCE, rounds=M.PAIR_ROUNDS):
    """What the pairs add to every text, by dictionaries and loops."""
    h = lambda w: M.Tokens.of(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hashes
    texts = [(t or "").encode().lower().split() for _, t in rows]
    where = {w: (int(M.word_classes(h(w))[0]), int(M.word_cells(h(w))[0])) for t in texts for w in t}
    learned = [t for (i, _), t in zip(rows, texts) if not held(i)]
    mass, seen, total = Counter(), Counter(), Counter()
    for w, n in Counter(w for t in learned for w in t).items():
        mass[where[w][1]] += n + M.ALPHA
    for t in learned:
        for a, w in zip([None, *t], t):
            seen[a, where[w][1]] += 1
            total[a, where[w][0]] += 1
    of_class = Counter()
    for c, m in mass.items():
        of_class[c // M.CELLS] += m
    share = lambda c: (mass[c] + M.ALPHA / M.CELLS) / (of_class[c // M.CELLS] + M.ALPHA)
    weight = dict.fromkeys(seen, 0.0)

    def norms():
        z = Counter()
        for (a, c), v in weight.items():
            z[a, c // M.CELLS] += share(c) * math.expm1(v)
        return z

    for _ in range(rounds):
        z = norms()
        for (a, c), v in list(weight.items()):
            m = total[a, c // M.CELLS] * share(c) * math.exp(v) / (1 + z[a, c // M.CELLS])
            step = (seen[a, c] - m - v / variance) / (m + 1 / variance)
            weight[a, c] = v + max(-M.PAIR_LIMIT, min(M.PAIR_LIMIT, step))
    z = norms()
    return [sum(weight.get((a, where[w][1]), 0) - math.log(1 + z[a, where[w][0]]) for a, w in zip([None, *t], t))
            for t in texts]


@pytest.mark.parametrize("owners,wide,texts", [(1, 4096, 2048), (7, 4096, 3), (5, 20, 2048)])
def test_pairs_against_plain_loops(spark, monkeypatch, owners, wide, texts):
    rows = docs()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    df = (spark.createDataFrame([(k, t or "", held(i)) for k, (i, t) in enumerate(rows)],
                                "row long, text string, held_out boolean").coalesce(1))
    counts = M.count_words(df.where("not held_out"))
    shares = M.cell_shares(counts)
    assert np.allclose(shares.reshape(M.CLASSES, -1).sum(1), 1, atol=1e-5)
    if wide < 4096:                                   # previous words that are dealt by class
        monkeypatch.setattr(M, "WIDE", wide)
        monkeypatch.setattr(M, "OWNED", 4)
    many = M.wide_words(counts, sum(r.n for r in counts.collect()))
    assert (len(many) > 0) == (wide < 4096)
    if texts < 2048:                                  # rows of many slices
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", texts)
    try:
        got = {r.row: r.pairs for r in M.pair_scores(df, shares, owners, many).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = _plain_pairs(rows, held)
    assert all(got.get(k, 0) == pytest.approx(v, rel=1e-4, abs=1e-4) for k, v in enumerate(want))
    assert set(got) <= set(range(len(rows)))


def test_pair_weights_are_a_distribution_at_the_optimum():
    """Cells of one class after one word: probabilities add up to one, and after
    many rounds the penalised likelihood has no slope left."""
    rng = np.random.default_rng(3)
    share = rng.dirichlet(np.ones(50))
    n = np.where(rng.random(50) < .5, rng.integers(1, 30, 50), 0).astype(float)
    group = np.zeros(50, np.int64)
    adds = M.pair_weights(n, group, share, 1000)
    p = share * np.exp(adds)
    assert p.sum() == pytest.approx(1)
    weight = adds - adds[n == 0][0]
    assert np.abs(n - n.sum() * p - weight / M.VARIANCE)[n > 0].max() < 1e-6
    assert len(M.pair_weights(np.zeros(0), np.zeros(0, np.int64), np.zeros(0))) == 0
    assert np.allclose(M.pair_weights(np.zeros(4), np.zeros(4, np.int64), np.full(4, .25)), 0)


def test_held_out_texts_gain_over_the_base(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = M.lm_scores(df, crc32_mod("doc_id", 10) == 0).where("held_out")
    better, gain = got.agg(F.avg((F.col("score") > F.col("base_score")).cast("int")),
                           F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).first()
    print(f"held out: better {better:.3f}, log10 a token {gain:.3f}")
    assert better > 0.9 and gain > 0.1
