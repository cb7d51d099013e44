import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigflow.llm import langid as L
from sigflow.llm.common import crc32_mod


def brute_bundle(text):
    """Letter by letter, from the letters' own vectors."""
    def vector(symbol):
        return L.letter_vectors(np.array([symbol]), L.DIMENSIONS, L.SEED)[0].astype(int)

    out, seq = np.zeros(L.DIMENSIONS, int), [0]
    for c in text:
        low = c.lower()
        letter = c.isalpha() or unicodedata.category(c)[0] == "M"
        s = 0 if not letter else ord(low) - 96 if "a" <= low <= "z" else ord(low) + L.LATIN
        if s or seq[-1]:
            seq.append(s)
    if seq[-1]:
        seq.append(0)
    for i in range(len(seq) - 2):
        out += np.roll(vector(seq[i]), 2) * np.roll(vector(seq[i + 1]), 1) * vector(seq[i + 2])
    return out


def test_bundle_is_the_sum_of_bound_letters():
    texts = ["Hello, wörld 12 ab", "x", "a  b", "éa-b", "Привет МИР", "e\u0301t", "日本 語"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for t, (latin, other, has) in zip(texts, L.gram_counts(data, offsets)):
        assert has and np.array_equal(L.bundle(latin, other, L.DIMENSIONS, L.SEED), brute_bundle(t))


def test_letters_have_vectors_of_their_own():
    letters = L.letter_vectors(L.symbols()[0x430:0x450], L.DIMENSIONS, L.SEED).astype(int)
    close = np.abs(letters @ letters.T - L.DIMENSIONS * np.eye(32, dtype=int))
    assert close.max() < L.DIMENSIONS // 4
    assert (L.symbols()[0x410:0x430] == L.symbols()[0x430:0x450]).all()      # lower-cased


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_labels_without_letters_in_a_task(spark, parts):
    for rows in ([(0, "the cat", "en"), (1, "123", "fr")], [(0, "123", "fr"), (1, "the cat", "en")],
                 [(0, "the cat", "en"), (1, None, "fr"), (2, "", "de")]):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        got = {r.doc_id: r.lang_pred for r in L.identify(df, F.lit(False)).collect()}
        assert got == {i: "en" if text == "the cat" else "und" for i, text, _ in rows}


def test_two_languages_of_one_script(spark):
    ru = ["мама мыла раму и пошла домой, потому что было уже поздно", "кошка сидит на окне и смотрит на улицу",
          "он был в школе и не знал, что это его книга", "мы видели большой город и старый мост через реку",
          "что ты делал вчера, когда они были на реке и смотрели на мост"]
    uk = ["мати мила вікно і пішла додому, тому що було вже пізно", "кішка сидить на вікні і дивиться на вулицю",
          "він був у школі і не знав, що це його книжка", "ми бачили велике місто і старий міст через річку",
          "що ти робив учора, коли вони були на річці і дивилися на міст"]
    rows = [(i, t, "ru", i == 4) for i, t in enumerate(ru)] + [(10 + i, t, "uk", i == 4) for i, t in enumerate(uk)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, held boolean")
    got = {r.doc_id: r.lang_pred for r in L.identify(df, F.col("held")).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_edges_and_ties(spark):
    rows = [(0, "the cat the dog", "en", 1.0), (1, "le chat le chien", "fr", 2.0), (1, "le chat le chien", "fr", 2.0),
            (2, None, "en", 0.0), (3, "", None, 0.0), (4, "123 $$$ 。", "fr", 0.0), (None, "the dog " * 3000, None, 1.0),
            (5, "le chien", None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred) for r in L.identify(df, F.lit(False)).collect()}
    assert got == {(0, "en"), (1, "fr"), (2, "und"), (3, "und"), (4, "und"), (None, "en"), (5, "fr")}
    assert L.identify(df, F.lit(False)).count() == len(rows)
    assert {r.lang_pred for r in L.identify(df, F.lit(True)).collect()} == {"und"}
    assert L.identify(df.limit(0), F.lit(False)).collect() == []


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.identify(df, crc32_mod("doc_id", 4) == 2).join(df.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out & (out.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert out.score.between(0, 1).all()
