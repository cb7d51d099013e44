import hashlib

import numpy as np
import pytest

from sigflow.llm import suffix_dedup as S


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            count[r[i:i + length]] = count.get(r[i:i + length], 0) + 1
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


def texts():
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcé \n"), n))
    shared = [word(n) for n in (20, 35, 19, 90)]
    out = [None, "", "short", "a" * 300, "ab" * 100, word(4000)]
    for _ in range(40):
        out.append(word(rng.integers(0, 60)) + shared[rng.integers(0, 4)] + word(rng.integers(0, 60)) + shared[rng.integers(0, 4)])
    return out + [out[-1], out[-1], shared[3][5:60], word(30) + shared[3][:30]]


@pytest.mark.parametrize("large", [100_000, 1])
def test_against_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(S, "BLOCK_SUFFIXES", large)      # 1: every block meets by window hashes
    monkeypatch.setattr(S, "TASK_SUFFIXES", 30)
    all_texts = texts()
    rows = [(i if i != 8 else None, t, "x") for i, t in enumerate(all_texts)] + [(0, "short", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = S.cut_repeats(df, 20, gram=8, keep=[]).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 20))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.cut_repeats(df).collect() == []
    assert S.cut_repeats(spark.createDataFrame([(1, "a" * 10)], "doc_id long, text string")).count() == 1
