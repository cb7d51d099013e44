import numpy as np
import xxhash

from sigflow.llm import simhash as S
from sigflow.llm.textbatch import padded


def test_xxh64_equals_the_library():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts, lens = rng.integers(0, 4000, 1500), rng.integers(0, 150, 1500)
    h = S.xxh64(padded(raw), starts, lens)
    assert [int(x) for x in h] == [xxhash.xxh64_intdigest(raw[s:s + n].tobytes(), 42) for s, n in zip(starts, lens)]


def brute_print(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(grams))


def test_forest_search_finds_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in rng.integers(0, 7, 400)], np.uint64)
    prints = np.unique(base[rng.integers(0, 40, 400)] ^ flips)
    shard = rng.integers(0, 3, len(prints))
    roots, keys, children = S.grow(prints, shard)
    names = np.unique(shard)
    found = set()
    for q, node in S.search(prints, prints, roots[np.searchsorted(names, shard)], keys, children, 4):
        found |= set(zip(q.tolist(), node.tolist()))
    d = np.bitwise_count(prints[:, None] ^ prints[None, :])
    want = set(zip(*map(list, map(np.ndarray.tolist, np.nonzero((d <= 4) & (shard[:, None] == shard[None, :]))))))
    assert found == want


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 5)           # parts of a split shard meet pairwise
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", " \t\n", "One", "one", "A b C"]
    for _ in range(25):
        doc = [words[i] for i in rng.integers(0, 60, 40)]
        texts += [" ".join(doc), "  ".join(doc).upper(), " ".join([*doc[:-1], "x"])]
    texts += [" ".join(words) * 400, "x" * 20000]
    rows = [(i if i != 7 else None, t, "print", 1) for i, t in enumerate(texts)] + [(3, "One", "again", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string, fingerprint int")
    got = S.simhash_groups(df, 4, 4).collect()
    assert len(got) == len(rows)
    prints = np.array([brute_print(t) for _, t, _, _ in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.arange(len(rows))
    a, b = np.nonzero(near)
    label = S.union(label, a, b)
    want = []
    for i, row in enumerate(rows):
        ids = [r[0] for r, x in zip(rows, label) if x == label[i] and r[0] is not None]
        want.append((row[0], format(int(prints[i]), "016x"), min(ids, default=None)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_groups(df).collect() == []
