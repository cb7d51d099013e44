import math
import re

import numpy as np
import pytest

from sigflow.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Every document scored for every item, by the formula."""
    bags = [terms(t) for _, t in docs]
    n, total = sum(bool(b) for b in bags), sum(map(len, bags))
    df = {}
    for b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for (doc, _), b in zip(docs, bags):
            m = 100 - 50 + (50 * len(b) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * b.count(t)) // (1000 * b.count(t) + 20 * m)) for t in set(terms(text)) & set(b))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    bank = [f"w{i}" for i in range(300)] + ["Über", "naïve", "日本", "x" * 40]
    p = 1 / np.arange(1, len(bank) + 1)
    docs = [(i, " ".join(rng.choice(bank, int(rng.integers(1, 80)), p=p / p.sum()))) for i in range(n)]
    items = [(i, " ".join(rng.choice(bank, int(rng.integers(1, 30))))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("parts, k, slice_bytes", [(1, 5, 1 << 20), (3, 50, 20_000), (8, 1, 3_000)])
def test_equals_brute_force(spark, monkeypatch, parts, k, slice_bytes):
    docs, items = corpus(parts, 900)
    docs += [(900 + i, docs[7][1]) for i in range(60)]                 # ties by id
    docs += [(2000, None), (2001, ""), (2002, "--- !!"), (None, docs[7][1]), (3, docs[3][1]), (2003, "w0 " * 40_000)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, docs[7][1]), (103, docs[7][1]), (None, "w5 W5 日本")]
    monkeypatch.setattr(X, "SEGMENT_BYTES", slice_bytes)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    q = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    index = X.build_index(d)
    assert index.count() >= parts
    got = sorted(map(tuple, X.search(index, q, k).collect()), key=str)
    assert got == brute(docs, items, k)
    # several blocks of queries give the same
    monkeypatch.setattr(X, "QUERY_TERMS", 100)
    assert sorted(map(tuple, X.search(index, q, k).collect()), key=str) == got


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert X.search(X.build_index(d.limit(0)), q, 3).collect() == []
    assert X.search(X.build_index(d.where("text IS NULL")), q, 3).collect() == []
    assert X.search(X.build_index(d), q.limit(0), 3).collect() == []
    assert [tuple(r) for r in X.search(X.build_index(d), q, 3).collect()] == brute([(1, "a b"), (2, None)], [(1, "b")], 3)


def test_blocks_round_trip_and_maxima():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 100_000, 70_000)
    pairs = [(t, np.sort(rng.choice(70_000, n, replace=False))) for t, n in enumerate([1, 128, 129, 5000, 70_000])]
    term = np.concatenate([np.full(len(d), t) for t, d in pairs])
    doc = np.concatenate([d for _, d in pairs])
    tf = rng.choice([1, 2, 300, 70_000], len(doc))
    row = X.compress(term, doc, tf, size, len(pairs))
    lists = X.Lists({n: v.tobytes() for n, v in row.items()})
    scorer = X.Scorer(70_000, int(size.sum()))
    part = scorer.part(tf, size[doc])
    most = np.maximum.reduceat(scorer.part(lists.often.astype(np.int64), lists.long.astype(np.int64)), lists.edges[:-1])
    for t in range(len(pairs)):
        blocks = np.arange(lists.lists[t], lists.lists[t + 1])
        back, often, count = lists.postings(blocks, blocks == blocks[0])
        assert np.array_equal(back, doc[term == t]) and np.array_equal(often, tf[term == t])
        ends = np.cumsum(count) - count
        assert np.array_equal(np.maximum.reduceat(part[term == t], ends), most[blocks])
        some = blocks[1::3]                                            # blocks in the middle of a list
        if len(some):
            again, _, _ = lists.postings(some, some == blocks[0])
            assert np.isin(again, back).all()


def test_blocks_are_rejected_unread(monkeypatch):
    """With a floor, few blocks of a common list are decompressed."""
    rng = np.random.default_rng(5)
    texts = [" ".join(["common"] * int(rng.integers(1, 4)) + ["fill"] * int(rng.integers(1, 60))
                      + ["rare"] * (i % 97 == 0)) for i in range(20_000)]
    raw = [t.encode() for t in texts]
    made = X.segment(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    lists = X.Lists({n: v.tobytes() for n, v in made.items()})
    size = lists.sizes.astype(np.int64)
    scorer = X.Scorer(len(texts), int(size.sum()))
    most = np.maximum.reduceat(scorer.part(lists.often.astype(np.int64), lists.long.astype(np.int64)), lists.edges[:-1])
    terms_ = [b"common", b"rare"]
    at = lists.find(terms_, X.span_hashes(X.padded(np.frombuffer(b"commonrare", np.uint8)), np.array([0, 6]), np.array([6, 4])))
    assert (at >= 0).all()
    found = [(w, int(lists.lists[p]), most[lists.lists[p]:lists.lists[p + 1]]) for w, p in zip((10, 4000), at)]
    read = []
    inner = lists.postings
    monkeypatch.setattr(lists, "postings", lambda b, f: read.append(len(b)) or inner(b, f))
    doc, score = X.best_of_segment(lists, size, found, scorer, 10, 1)
    everything = sum(read)
    top = np.sort(score)[-10]
    read.clear()
    doc2, score2 = X.best_of_segment(lists, size, found, scorer, 10, int(top))
    assert set(doc2[score2 >= top]) == set(doc[score >= top]) and sum(read) < everything / 2


def test_a_segment_is_built_in_bounded_memory():
    """What a task holds while it indexes one slice of full size."""
    import tracemalloc
    words = " ".join(f"w{i}" for i in np.random.default_rng(0).integers(0, 20_000, X.SEGMENT_BYTES // 7)).encode()
    X.segment(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))          # imports and tables
    tracemalloc.start()
    X.segment(np.frombuffer(words, np.uint8), np.array([0, len(words)]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 45 << 20, most >> 20


def test_a_task_holds_few_segments_at_once(spark, monkeypatch):
    """A row group is read whole: all segments of a file used to be one."""
    import pyarrow.parquet as pq

    from sigflow.llm import lexical
    monkeypatch.setattr(lexical, "SEGMENT_BYTES", 2000)
    monkeypatch.setattr(lexical, "GROUP_BYTES", 8000)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), i -> md5(string(id * i)))) AS text")
    index = lexical.build_index(docs.coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file:").replace("//", "/")).metadata for f in index.inputFiles()]
    groups = [m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)]
    assert sum(groups) == index.count() > 300 and max(groups) <= 4
