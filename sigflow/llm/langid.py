"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code
point; a letter ``k`` places before the end of an n-gram is permuted (rotated)
``k`` times, an n-gram's vector is the product (binding) of its letters'
vectors, a text's vector the sum (bundle) of its n-grams' vectors. A language's
prototype is the bundle of all its training texts. A text gets the language of
the prototype with the largest cosine. Letters of all scripts are lower-cased;
combining marks count as letters inside a text that has letters.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigflow.llm.common import text_of
from sigflow.llm.pieces import LETTER, classes, decode
from sigflow.llm.textbatch import mix, slices

DIMENSIONS = 512
GRAM = 3
SEED = 7
UNKNOWN = "und"
LATIN = 27                   # symbols 0 (between words) to 26 (z): bound vectors kept as a table
SHIFT = 21                   # bits of a symbol in an n-gram's code
BLOCK = 4096                 # n-grams bound at once
HELD = 1 << 20               # n-grams of one language held before they are bundled


@functools.lru_cache(1)
def symbols() -> np.ndarray:
    """The symbol of every code point: 1 to 26 for a-z, ``LATIN`` + its
    lower-case code point for any other letter or mark, else 0."""
    import regex
    lower = np.arange(0x110000, dtype=np.int32)
    for c in range(0x1F000):             # no cased letter lies beyond
        if not 0xD800 <= c < 0xE000:
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
    own = classes() == LETTER
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    own[[ord(c) for c in regex.findall(r"\p{M}", every)]] = True
    out = np.where((lower >= 97) & (lower < 123), lower - 96, lower + LATIN)
    return np.where(own, out, 0).astype(np.int32)


def letter_vectors(symbol: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The vectors of symbols: one +1 or -1 for each bit of their hashes."""
    words = np.arange(-(-dimensions // 64), dtype=np.uint64)
    with np.errstate(over="ignore"):
        key = mix(symbol.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        bits = mix(mix(key[:, None] + (words + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)))
    flags = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(len(symbol), -1), axis=1, bitorder="little")
    return (2 * flags[:, :dimensions].astype(np.int8) - 1)


def bind(code: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The bound vectors of n-gram codes."""
    out = np.ones((len(code), dimensions), np.int8)
    for k in range(GRAM):
        found, of = np.unique((code >> (SHIFT * k)) & ((1 << SHIFT) - 1), return_inverse=True)
        out *= np.roll(letter_vectors(found, dimensions, seed), k, axis=1)[of]
    return out


@functools.lru_cache(2)
def latin_vectors(dimensions: int, seed: int) -> np.ndarray:
    """The bound vectors of the n-grams over a-z and the separator."""
    at = np.arange(LATIN**GRAM)
    code = sum(((at // LATIN**k) % LATIN) << (SHIFT * k) for k in range(GRAM))
    return bind(code, dimensions, seed).astype(np.float32)


def bundle(latin: tuple, other: tuple, dimensions: int, seed: int) -> np.ndarray:
    """The sum of n-gram vectors: ``latin`` (places in the table, counts) and
    ``other`` (codes, counts)."""
    code, count = latin
    kind = np.float32 if count.sum() + other[1].sum() < 1 << 24 else np.float64      # whole numbers either way
    out = np.zeros(dimensions, kind)
    for a in range(0, len(code), BLOCK):
        out += count[a:a + BLOCK].astype(kind) @ latin_vectors(dimensions, seed)[code[a:a + BLOCK]].astype(kind, copy=False)
    code, count = other
    for a in range(0, len(code), BLOCK):
        out += count[a:a + BLOCK].astype(kind) @ bind(code[a:a + BLOCK], dimensions, seed).astype(kind)
    return out.astype(np.float64)


def _counted(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(code) > size // 8:
        full = np.bincount(code, minlength=size)
        found = np.flatnonzero(full)
        return found, full[found]
    return np.unique(code, return_counts=True)


def gram_counts(data: np.ndarray, offsets: np.ndarray):
    """Per text: (places in the table and counts of its n-grams over a-z,
    codes and counts of the others, whether it has a letter). N-grams run over
    words with one separator around each."""
    none = np.zeros(0, np.int64)
    if not len(data):
        for _ in range(len(offsets) - 1):
            yield (none, none), (none, none), False
        return
    points, _, heads = decode(data, offsets)
    sym, letter = symbols()[points], classes()[points] == LETTER
    for a, b in zip(heads[:-1], heads[1:]):
        if not letter[a:b].any():
            yield (none, none), (none, none), False
            continue
        s = sym[a:b]
        s = s[(s > 0) | np.concatenate([[False], s[:-1] > 0])]       # one separator at most
        s = np.concatenate([[0], s, [0]] if s[-1] else [[0], s]).astype(np.int64)
        runs = [s[GRAM - 1 - k:len(s) - k] for k in range(GRAM)]
        plain = np.logical_and.reduce([r < LATIN for r in runs])
        place = sum(r[plain] * LATIN**k for k, r in enumerate(runs))
        code = sum(r[~plain] << (SHIFT * k) for k, r in enumerate(runs))
        yield _counted(place, LATIN**GRAM), np.unique(code, return_counts=True), True


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS,
          seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """(languages in order, their prototypes) from every row with a language.

    Each task adds up n-grams by language and bundles them; ``dimensions``
    whole numbers a task and language are shuffled, as many a language reach
    the driver. A language without any letter in its texts is not learned."""
    rows = df.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    size, none = LATIN**GRAM, np.zeros(0, np.int64)

    def run(batches):
        latin: dict[str, np.ndarray] = {}
        others: dict[str, list] = {}
        sums: dict[str, np.ndarray] = {}

        def flush(lang):
            if others[lang]:
                code, of = np.unique(np.concatenate([c for c, _ in others[lang]]), return_inverse=True)
                count = np.bincount(of, np.concatenate([n for _, n in others[lang]])).astype(np.int64)
                sums[lang] += bundle((none, none), (code, count), dimensions, seed)
                others[lang] = []

        for batch, data, offsets in slices(batches):
            for lang, ((place, n), other, has) in zip(batch.column(0).to_pylist(), gram_counts(data, offsets)):
                if not has:
                    continue
                if lang not in latin:
                    latin[lang], others[lang], sums[lang] = np.zeros(size, np.int64), [], np.zeros(dimensions)
                latin[lang][place] += n
                if len(other[0]):
                    others[lang].append(other)
                    if sum(len(c) for c, _ in others[lang][-64:]) > HELD // 64 and \
                            sum(len(c) for c, _ in others[lang]) > HELD:
                        flush(lang)
        for lang, total in latin.items():
            flush(lang)
            place = np.flatnonzero(total)
            whole = sums[lang] + bundle((place, total[place]), (none, none), dimensions, seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions, pa.string()), pa.array(np.arange(dimensions), pa.int32()),
                 pa.array(whole.astype(np.int64), pa.int64())], ["lang", "place", "n"])

    found = (rows.mapInArrow(run, "lang string, place int, n long")
             .groupBy("lang", "place").agg(F.sum("n").alias("n")).collect())
    langs = sorted({r["lang"] for r in found})
    prototypes = np.zeros((len(langs), dimensions))
    at = {lang: i for i, lang in enumerate(langs)}
    for r in found:
        prototypes[at[r["lang"]], r["place"]] = r["n"]
    return langs, prototypes


def predict(df: DataFrame, langs: list[str], prototypes: np.ndarray, keep: dict[str, Column], text_col: str = "text",
            dimensions: int = DIMENSIONS, seed: int = SEED, letters: str | None = None) -> DataFrame:
    """The columns ``keep`` and lang_pred, score (the cosine, 0 if negative),
    and under the name ``letters``, if given, whether the text has a letter.
    A text that is NULL or has no letter is ``und`` with score 0; equal cosines
    give the language first in order."""
    rows = df.select(text_of(text_col).alias("_text"), *[c.alias(n) for n, c in keep.items()])
    unit = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-300)).T

    def run(batches):
        for batch, data, offsets in slices(batches, "_text"):
            bundles, lettered = [], []
            for latin, other, has in gram_counts(data, offsets):
                bundles.append(bundle(latin, other, dimensions, seed))
                lettered.append(has)
            x = np.array(bundles, np.float64).reshape(len(bundles), dimensions)
            pred, score = np.full(len(x), UNKNOWN, object), np.zeros(len(x))
            if len(langs):
                cosine = (x @ unit) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                best = np.round(cosine, 9).argmax(1)
                known = np.array(lettered, bool)
                pred[known] = np.array(langs, object)[best[known]]
                score[known] = np.clip(cosine[np.arange(len(x)), best], 0, 1)[known]
            made = {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)}
            if letters:
                made[letters] = pa.array(lettered, pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made.values()], [*batch.schema.names[1:], *made])

    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    if letters:
        schema = schema.add(letters, "boolean")
    return rows.mapInArrow(run, schema)


def identify(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not ``held_out`` and have a language, then
    predict every row: doc_id, held_out, lang_pred, score.

    Language, id and other columns are never inputs of a prediction. Repeated
    rows are predicted alike and, in training, count each; NULL languages are
    not learned from. Without any training row all texts are ``und``; an empty
    table gives an empty result."""
    langs, prototypes = train(df.where(~held_out), lang_col, text_col)
    return predict(df, langs, prototypes, {"doc_id": F.col(id_col), "held_out": held_out}, text_col)
