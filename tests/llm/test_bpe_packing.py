import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from sigflow.llm import bpe as B
from sigflow.llm import packing as K
from sigflow.llm.pieces import piece_starts
from sigflow.llm.textbatch import slices

random.seed(5)
LETTERS = "ab'srtvelmdéñ1٣$ 　\x1c\x85\U0001F600 \n\t\0"
TEXTS = ["", "'s", "it's 'll  x", "a'", "'", " ", "\n a", "x" * 5000, " " * 3000, "<|endoftext|>", "ab" * 2500 + "'s"] + [
    "".join(random.choice(LETTERS) for _ in range(random.randrange(1, 60))) for _ in range(600)]


@pytest.fixture(scope="module")
def tik():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        file = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
    return B.from_ranks(file), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def hug():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        return B.from_json(f.read()), t


def batches(texts):
    return slices([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])], limit=4096)


def test_pieces_equal_the_pattern():
    pattern = regex.compile(P.PATTERN)
    for batch, data, offsets in batches(TEXTS):
        starts = set(piece_starts(data, offsets).tolist())
        want, at = set(), 0
        for t in batch.column(0).to_pylist():
            for m in pattern.findall(t):
                want.add(at)
                at += len(m.encode())
        assert starts == want


def test_ids_equal_both_libraries(tik, hug):
    for batch, data, offsets in batches(TEXTS):
        a, at_a = tik[0].encode_texts(data, offsets)
        b, at_b = hug[0].encode_texts(data, offsets)
        for i, t in enumerate(batch.column(0).to_pylist()):
            assert a[at_a[i]:at_a[i + 1]].tolist() == tik[1].encode_ordinary(t)
            assert b[at_b[i]:at_b[i + 1]].tolist() == hug[1].encode(t, add_special_tokens=False).ids
            assert tik[0].decode(a[at_a[i]:at_a[i + 1]]).tobytes() == t.encode()


def test_tokens_that_merges_do_not_build():
    # 'abc' is a token, but neither ab+c nor a+bc can be reached: the whole piece still is that token
    tokens = [bytes([i]) for i in range(256)] + [b"abc"]
    bpe = B.Bpe(tokens, {}, whole=True)
    ids, at = bpe.encode_texts(np.frombuffer(b"abc ab", np.uint8), np.array([0, 6]))
    assert ids.tolist() == [256, 32, 97, 98]


def test_query_rows(spark, tik):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, None, 1), (3, "a'", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = B.bpe_digests(df, P.path("byte_bpe_multi_50k.tiktoken")).collect()
    want = []
    for i, t, _ in rows:
        ids = tik[1].encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert B.bpe_digests(df.limit(0), P.path("byte_bpe_multi_50k.tiktoken")).collect() == []


def brute_ffd(sizes, capacity):
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((k for k, held in enumerate(bins) if held + sizes[i] <= capacity), len(bins))
        if b == len(bins):
            bins.append(0)
        out[i] = (b, bins[b])
        bins[b] += sizes[i]
    return out


def test_first_fit_decreasing():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 257):
        sizes = rng.integers(1, 33, n)
        bins, offsets = K.first_fit_decreasing(sizes, 32)
        assert list(zip(bins.tolist(), offsets.tolist())) == brute_ffd(sizes.tolist(), 32)


def test_packing(spark, hug):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS * 2)] + [(None, None, 0), (None, "a b", 0), (0, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    got = K.pack_documents(df, P.path("byte_bpe_50k.json"), 64, group_pieces=100).toPandas()
    want = []
    for i, t, _ in rows:
        ids = hug[1].encode(t or "", add_special_tokens=False).ids + [0]
        for s in range(0, len(ids), 64):
            part = ids[s:s + 64]
            want.append((-1 if i is None else i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    have = got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].fillna(-1).astype(int)
    assert sorted(want) == sorted(map(tuple, have.values.tolist()))
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    total = got.groupby("sequence_id")["length"].sum()
    assert total.max() <= 64 and total.sum() / (64 * len(total)) > 0.9
    assert K.pack_documents(df.limit(0), P.path("byte_bpe_50k.json"), 64).collect() == []
