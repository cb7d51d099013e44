"""The pipeline on a small fixture, stage by stage against brute force."""

import re
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from sigflow.llm.common import materialise
from sigflow.llm.simhash import union

from test_simhash import brute_print
from test_suffix_dedup import brute as brute_cut


def fixture():
    rng = np.random.default_rng(11)
    bank = [f"{a}{b}" for a in "the of und der les que".split() for b in "ka lo mi nu ré".split()]
    text = lambda n: " ".join(rng.choice(bank, n))
    passage, base = text(60), [text(int(n)) for n in rng.integers(30, 120, 14)]
    texts = base + [base[0], base[1] + " \n", base[2] + " x", None, "", "12 $$", passage + " " + text(40), text(30) + " " + passage]
    langs = ["en", "de", None, "fr"]
    return [(i if i != 5 else None, t, langs[i % 4], f"s{i}", len(t or ""), "extra") for i, t in enumerate(texts)] + \
        [(3, base[3], "en", "s3", len(base[3]), "extra")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string"


@pytest.mark.parametrize("rows", [fixture(), []])
def test_stages(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, at = docs.columns, [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        out = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            want = [r for r in at if r[1] and any(c.isalpha() for c in r[1])]
        elif name == "exact_dedup":
            best = {}
            for r in at:
                key = re.sub(r"[\x20\x09-\x0D]", "", r[1])
                rank = (-len(r[1]), r[0] is None, r[0] or 0)
                if key not in best or rank < best[key][0]:
                    best[key] = (rank, r)
            want = [r for _, r in best.values()]
        elif name == "simhash_dedup":
            prints = np.array([brute_print(r[1]) for r in at], np.uint64)
            a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
            label = union(np.arange(len(at)), a, b)
            want = [min((r for r, y in zip(at, label) if y == x), key=lambda r: (r[0] is None, r[0] or 0)) for x in set(label.tolist())]
        elif name == "suffix_dedup":
            cut = brute_cut([r[1] for r in at], 200)
            want = [(r[0], c[4], r[2], r[3], len(c[4]), r[5]) for r, c in zip(at, cut)]
            assert not rows or sum(c[1] for c in cut) > 0
        else:
            tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
            want, out = [], [r[:5] for r in out]
            for r in at:
                ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
                want += [(r[0], s, len(ids[s:s + 1024]), zlib.crc32(np.array(ids[s:s + 1024], "<u4").tobytes()), len(ids))
                         for s in range(0, len(ids), 1024)]
        assert sorted(map(repr, out)) == sorted(map(repr, want)), name
        at = out


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


@pytest.mark.parametrize("label", [None, "und"])
def test_language_stage_keeps_texts_with_letters(spark, label):
    rows = [(i, t, label, "s", 0, "x") for i, t in enumerate(["some words", "12 $$", None, "", "\u0434\u0430"])]
    out = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], rows[4]]
