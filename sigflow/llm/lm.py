"""Language-model scores: a smoothed unigram base and a hashed maximum-entropy
model.

The maximum-entropy model factors a word's probability into that of its class,
that of the word's cell (a hash) in its class and that of the word in its cell.

The class has a softmax over the sum of weight rows picked by hashed features of
the context: the previous word, the previous two, and the word before the
previous one (a skip). Training is full gradient descent: in each round every
task sums the gradient over its documents, the sums are added up in two levels
of tasks and the driver, which holds only the bounded weight table, makes the
update.

The cell has a softmax over the cells of its class, with the cells' shares of
the class as reference measure and a weight for every pair (previous word, cell)
of the training texts, so the features grow with the input. Pairs without a
weight add nothing, so a normaliser is a sum over the seen pairs of a (previous
word, class). Tokens are dealt by the previous word, packed by slices of text;
the owner task counts its pairs, makes the gradient updates of their weights and
sends back what they add to the score of every text.

The word has its smoothed share of its cell. Word counts live in a table; the
commonest words, bounded in number, are broadcast and the others joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigflow.llm.common import fix_splits, materialise, text_of
from sigflow.llm.textbatch import distinct_spans, lower_bytes, mix, padded, slices, span_hashes, words_of

CLASSES = 32                 # word classes; the end of a text is one more
BUCKETS = 1024               # hashed features of each of the three kinds
ROUNDS = 3
BROADCAST_WORDS = 60_000     # words whose counts are broadcast, at most
ALPHA = 0.1
CHUNK = 1 << 14              # tokens at once: their rows fit a core's cache
STEP, PRIOR, LIMIT = 0.5, 8.0, 2.0
CELLS = 1 << 15              # cells of a class
OWNED = 1 << 20              # tokens dealt to an owner of previous words, about
WIDE = 4096                  # a previous word before more than 1/WIDE of the tokens is dealt by class
VARIANCE, PAIR_ROUNDS, PAIR_LIMIT = 5.0, 5, 2.0
TEXTS = 1 << 11              # texts packed together, at most
_START = np.uint64(0x51ED270B9F4A7C15)


def word_classes(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(17)) % np.uint64(CLASSES)


def word_cells(h: np.ndarray) -> np.ndarray:
    """The cell of a word among all classes' cells."""
    return word_classes(h) * np.uint64(CELLS) + (h >> np.uint64(40)) % np.uint64(CELLS)


@dataclass
class Tokens:
    """The words of a slice of texts; tokens are words and one end a text."""
    data: np.ndarray
    starts: np.ndarray
    lens: np.ndarray
    hashes: np.ndarray
    first: np.ndarray        # first word of every text, and the end

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        data = lower_bytes(data)
        starts, lens, first = words_of(data, offsets)
        return cls(data, starts, lens, span_hashes(padded(data), starts, lens), first)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class of every token, its three feature buckets, first token of
        every text and the end)."""
        texts = len(self.first) - 1
        at = self.first + np.arange(texts + 1)
        word = np.ones(int(at[-1]), bool)
        word[at[1:] - 1] = False
        label = np.full(len(word), CLASSES, np.int64)
        label[word] = word_classes(self.hashes)
        h = np.zeros(len(word) + 2, np.uint64)         # two places ahead: the context of token i is h[i], h[i+1]
        h[2:][word] = self.hashes
        near, far = h[1:-1].copy(), h[:-2].copy()
        near[at[:-1]] = far[at[:-1]] = _START
        second = at[:-1][np.diff(at) > 1] + 1
        far[second] = _START
        b, k = np.uint64(BUCKETS), np.uint64(0x9E3779B97F4A7C15)
        return label, np.stack([mix(near * k) % b, mix((near ^ mix(far * k)) * k) % b,
                                mix(far * k + np.uint64(1)) % b]).astype(np.int16), at


def _exponentials(weights: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logits less their greatest if large, their exponentials)."""
    z = weights[0].take(feats[0], 0)
    z += weights[1].take(feats[1], 0)
    z += weights[2].take(feats[2], 0)
    if len(z) and (z.max() > 60 or z.min() < -60):
        z -= z.max(1, keepdims=True)
    return z, np.exp(z)


def log_softmax(weights: np.ndarray, feats: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The log probability of every label."""
    z, e = _exponentials(weights, feats)
    return z[np.arange(len(z)), label] - np.log(e.sum(1))


def add_gradient(weights: np.ndarray, label: np.ndarray, feats: np.ndarray, out: np.ndarray) -> None:
    """Add the gradient of the log likelihood; the last column counts tokens."""
    for a in range(0, len(label), CHUNK):
        f, y = feats[:, a:a + CHUNK], label[a:a + CHUNK]
        _, r = _exponentials(weights, f)
        r /= -r.sum(1, keepdims=True)
        r[np.arange(len(y)), y] += 1
        for k in range(3):
            order = np.argsort(f[k], kind="stable")
            s = f[k][order]
            lead = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            out[k][s[lead], :-1] += np.add.reduceat(r.take(order, 0), lead, axis=0)
            out[k][:, -1] += np.bincount(s, minlength=BUCKETS)


def total_of_blocks(parts: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Rows (block, task, values as bytes) added up by block: first over about
    the square root of the tasks at a time, then over those sums."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.float64) for b in pdf["sums"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "task": pdf["task"].iloc[:1], "sums": [total.tobytes()]})

    schema, side = "block long, task long, sums binary", max(1, math.isqrt(tasks))
    once = (parts.withColumn("task", F.pmod("task", F.lit(side))).groupBy("block", "task").applyInPandas(add, schema))
    rows = once.groupBy("block").applyInPandas(add, schema).collect()        # one row per block: bounded
    return {r["block"]: np.frombuffer(r["sums"], np.float64) for r in rows}


def gradient(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """The gradient over all rows (3, BUCKETS, CLASSES + 1) and token counts."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)               # under half a MB
    blocks = 8

    def run(batches):
        from pyspark import TaskContext
        w = shared.value
        out = np.zeros((3, BUCKETS, CLASSES + 2))
        for _, data, offsets in slices(batches):
            label, feats, _ = Tokens.of(data, offsets).features()
            add_gradient(w, label, feats, out)
        task = TaskContext.get().partitionId()
        parts = out.astype(np.float32).astype(np.float64).reshape(3 * blocks, -1)
        some = [k for k in range(3 * blocks) if parts[k].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array([task] * len(some), pa.int64()),
             pa.array([parts[k].tobytes() for k in some], pa.binary())], ["block", "task", "sums"])

    parts = rows.select("text").mapInArrow(run, "block long, task long, sums binary")
    sums = total_of_blocks(parts, rows.rdd.getNumPartitions())
    out = np.zeros((3 * blocks, BUCKETS // blocks * (CLASSES + 2)))
    for k, v in sums.items():
        out[k] = v
    return out.reshape(3, BUCKETS, CLASSES + 2)


def fit(rows: DataFrame, class_tokens: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after ``rounds`` gradient steps over all rows, starting from the
    classes' shares. A step is the mean residual of a feature's tokens, scaled
    by the class's share (its curvature) and damped for rare features."""
    share = (class_tokens + 1) / (class_tokens + 1).sum()
    weights = np.repeat(np.log(share)[None, None, :] / 3, 3, 0).repeat(BUCKETS, 1).astype(np.float32)
    for _ in range(rounds):
        g = gradient(rows, weights)
        move = STEP * g[..., :-1] / (g[..., -1:] * share + PRIOR)
        weights = (weights + np.clip(move, -LIMIT, LIMIT)).astype(np.float32)
    return weights


def count_words(rows: DataFrame) -> DataFrame:
    """(word, class, n) over all rows."""
    def run(batches):
        for _, data, offsets in slices(batches):
            t = Tokens.of(data, offsets)
            first, code = distinct_spans(t.data, t.starts, t.lens)
            raw = t.data.tobytes()
            s, n = t.starts[first].tolist(), t.lens[first].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([raw[a:a + b] for a, b in zip(s, n)], pa.binary()),
                 pa.array(word_cells(t.hashes[first]).astype(np.int32)),
                 pa.array(np.bincount(code, minlength=len(first)))], ["word", "cell", "n"])

    return (rows.select("text").mapInArrow(run, "word binary, cell int, n long")
            .groupBy("word", "cell").agg(F.sum("n").alias("n"))
            .select("word", F.floor(F.col("cell") / CELLS).cast("int").alias("class"), "cell", "n"))


def cell_shares(counts: DataFrame) -> np.ndarray:
    """Every cell's share of its class (a sum of 1 a class): n + ALPHA for each
    of its words, and the cells' part of the ALPHA of unknown words."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        mass = np.full(CELLS, ALPHA / CELLS)
        mass[pdf["cell"].to_numpy() % CELLS] += pdf["mass"].to_numpy()
        return pd.DataFrame({"class": pdf["class"].iloc[:1], "share": [(mass / mass.sum()).astype(np.float32).tobytes()]})

    cells = counts.groupBy("class", "cell").agg((F.sum("n") + ALPHA * F.count("*")).alias("mass"))
    out = np.full((CLASSES, CELLS), 1 / CELLS, np.float32)
    for r in cells.groupBy("class").applyInPandas(pack, "class int, share binary").collect():      # a row a class
        out[r["class"]] = np.frombuffer(r["share"], np.float32)
    return out.ravel()


def wide_words(counts: DataFrame, total: int) -> np.ndarray:
    """Hashes of the words that hold more than 1/WIDE of the tokens, and more
    than an owner's part."""
    found = counts.where(F.col("n") > max(total // WIDE, OWNED // 4)).select("word").collect()     # < WIDE rows
    words = [bytes(r["word"]) for r in found]
    lens = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    return np.sort(span_hashes(padded(data), np.cumsum(lens) - lens, lens))


def pair_weights(n: np.ndarray, group: np.ndarray, share: np.ndarray, rounds: int = PAIR_ROUNDS) -> np.ndarray:
    """What a pair adds to the log probability of its cell, given each pair's
    count in training, its (previous word, class) and its cell's share: its
    weight less the log of the normaliser. A step is the gradient of the log
    likelihood under a normal prior, over a bound of the curvature; pairs that
    training has not seen have weight 0."""
    total = np.bincount(group, n)[group] if len(n) else np.zeros(0)
    seen, weight = n > 0, np.zeros(len(n))
    norm = np.ones(len(n))
    for left in range(rounds, -1, -1):
        norm = 1 + np.bincount(group, share * np.expm1(weight))[group] if len(n) else norm
        if left:
            mass = total * share * np.exp(weight) / norm
            step = (n - mass - weight / VARIANCE) / (mass + 1 / VARIANCE)
            weight += np.where(seen, np.clip(step, -PAIR_LIMIT, PAIR_LIMIT), 0)
    return weight - np.log(norm)


def pack_pairs(rows: DataFrame, owners: int, wide: np.ndarray) -> DataFrame:
    """(owner, slice, contexts, sizes, codes): the words of up to TEXTS texts
    whose previous words belong to one owner. A code is 20 bits for the cell, 11
    for the text and one for a held-out text; ``slice`` is the first text's row."""
    edges = np.array([(k << 64) // owners for k in range(1, owners)], np.uint64)

    def one(batch, data, offsets):
        t = Tokens.of(data, offsets)
        m = len(t.hashes)
        doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
        context = np.empty(m, np.uint64)
        context[1:] = t.hashes[:-1]
        context[t.first[:-1][np.diff(t.first) > 0]] = _START
        cell = word_cells(t.hashes)
        if len(wide):
            at = np.minimum(np.searchsorted(wide, context), len(wide) - 1)
            context = np.where(wide[at] == context, mix(context + word_classes(t.hashes) + np.uint64(1)), context)
        context = mix(context * np.uint64(0x9E3779B97F4A7C15))
        held = np.array([x is not False for x in batch.column(2).to_pylist()], bool)
        code = (cell.astype(np.uint32) << np.uint32(12)) | (doc << 1 | held[doc]).astype(np.uint32)
        order = np.argsort(context)
        context, code = context[order], code[order]
        lead = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if m else np.zeros(0, np.int64)
        distinct, size = context[lead], np.diff(np.append(lead, m)).astype(np.uint32)
        cut = np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]])
        of = np.flatnonzero(np.diff(cut))
        begin = np.append(cut[of], len(distinct))
        tokens = np.append(lead, m)[begin]

        def binary(values, bounds, width):
            return pa.Array.from_buffers(pa.binary(), len(of), [
                None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(values)])

        return pa.RecordBatch.from_arrays(
            [pa.array(of, pa.int64()), pa.array(np.full(len(of), batch.column(0)[0].as_py()), pa.int64()),
             binary(distinct, begin, 8), binary(size, begin, 4), binary(code, tokens, 4)],
            ["owner", "slice", "contexts", "sizes", "codes"])

    def run(batches):
        for batch, data, offsets in slices(batches):
            for a in range(0, batch.num_rows, TEXTS):
                o = offsets[a:a + TEXTS + 1]
                yield one(batch.slice(a, TEXTS), data[o[0]:o[-1]], o - o[0])

    return rows.select("row", "text", "held_out").mapInArrow(
        run, "owner long, slice long, contexts binary, sizes binary, codes binary")


def pair_scores(rows: DataFrame, shares: np.ndarray, owners: int, wide: np.ndarray) -> DataFrame:
    """(row, pairs): what the pairs add to the log probability of every text."""
    shared = rows.sparkSession.sparkContext.broadcast(shares)                # 4 bytes a cell: 4 MB

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        join = lambda name, kind: np.frombuffer(b"".join(pdf[name]), kind)
        code = join("codes", np.uint32)
        context, _ = pd.factorize(join("contexts", np.uint64))
        key = np.repeat(context, join("sizes", np.uint32)) << 20 | (code >> np.uint32(12))
        pair, keys = pd.factorize(key)
        n = np.bincount(pair[code & np.uint32(1) == 0], minlength=len(keys)).astype(np.float64)
        group, _ = pd.factorize(keys >> 15)
        adds = pair_weights(n, group, shared.value[keys & (CLASSES * CELLS - 1)].astype(np.float64))
        part = np.repeat(np.arange(len(pdf)), [len(b) // 4 for b in pdf["codes"]])
        at = part * TEXTS + (code >> np.uint32(1)).astype(np.int64) % TEXTS
        spots, which = pd.factorize(at)
        sums = np.bincount(spots, adds[pair])
        order = np.argsort(which, kind="stable")
        which, sums = which[order], sums[order]
        cut = np.searchsorted(which, np.arange(len(pdf) + 1) * TEXTS)
        texts = (which % TEXTS).astype(np.uint16)
        return pd.DataFrame({"slice": pdf["slice"], "texts": [texts[a:b].tobytes() for a, b in zip(cut, cut[1:])],
                             "sums": [sums[a:b].tobytes() for a, b in zip(cut, cut[1:])]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = np.frombuffer(b"".join(pdf["texts"]), np.uint16)
        sums = np.bincount(texts, np.frombuffer(b"".join(pdf["sums"]), np.float64))
        return pd.DataFrame({"row": pdf["slice"].iloc[0] + np.arange(len(sums)), "pairs": sums})

    parts = (pack_pairs(rows, owners, wide).groupBy("owner")
             .applyInPandas(own, "slice long, texts binary, sums binary"))
    return parts.groupBy("slice").applyInPandas(add, "row long, pairs double")


def common_words(counts: DataFrame, most: int = BROADCAST_WORDS) -> tuple[int, dict[bytes, int]]:
    """(least count, {word: count}) of the commonest words, at most ``most``:
    the least count is read off a histogram of counts."""
    size = F.floor(F.log2("n") * 8).cast("int")
    cells = sorted((r["size"], r["words"]) for r in
                   counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect())   # <= 8 * 64 rows
    least, held = 1 << 62, 0
    for cell, words in reversed(cells):
        held += words
        if held > most:
            break
        least = cell
    found = counts.where(size >= least) if least < 1 << 62 else counts.limit(0)
    return least, {bytes(r["word"]): r["n"] for r in found.select("word", "n").collect()}            # <= most rows


def lm_scores(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
              rounds: int = ROUNDS, most: int = BROADCAST_WORDS) -> DataFrame:
    """Learn from the rows that are not ``held_out`` and score every row:
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text with A-Z lowered, then one end. A NULL,
    empty or blank text is its end alone. Repeated rows count each in training
    and are scored alike; a NULL id stays NULL. With no training row N and V are
    0, so every token has the base probability 1 and the model's word
    probability within its class is 1. An empty table gives an empty result;
    other columns are not read. Scores are log10 probabilities. ``df`` is read
    several times and must give its rows in the same order each time, as a table
    does."""
    spark = df.sparkSession
    fix_splits(spark)                                # rows are numbered in two scans
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), held_out.alias("held_out"))
    learn = rows.where(~F.col("held_out"))
    counts = materialise(count_words(learn), "words")
    ends = learn.count()
    by = {r["class"]: (r["n"], r["v"]) for r in
          counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    class_n = np.array([by.get(k, (0, 0))[0] for k in range(CLASSES)], np.float64)
    class_v = np.array([by.get(k, (0, 0))[1] for k in range(CLASSES)], np.float64)
    total, distinct = int(class_n.sum()) + ends, int(class_v.sum()) + (ends > 0)
    weights = fit(learn, np.append(class_n, ends), rounds)
    least, common = common_words(counts, most)
    # log10 of a class's mass; a word's probability in its class is (c + alpha) / mass
    mass = np.append(np.log10(class_n + ALPHA * (class_v + 1)), 0.0)
    shared = spark.sparkContext.broadcast((weights, common, mass))       # bounded by the parameters
    end_log, base_log = math.log10(ends + ALPHA), math.log10(total + ALPHA * (distinct + 1))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        w, known, class_log = shared.value
        for batch, data, offsets in slices(batches):
            t = Tokens.of(data, offsets)
            label, feats, at = t.features()
            lp = np.empty(len(label))
            for a in range(0, len(label), CHUNK):
                lp[a:a + CHUNK] = log_softmax(w, feats[:, a:a + CHUNK], label[a:a + CHUNK])
            lp = lp / math.log(10) - class_log[label]
            sums = np.zeros(len(lp) + 1)
            np.cumsum(lp, out=sums[1:])
            model = sums[at[1:]] - sums[at[:-1]]
            first, code = distinct_spans(t.data, t.starts, t.lens)
            raw = t.data.tobytes()
            s, n = t.starts[first].tolist(), t.lens[first].tolist()
            words = [raw[a:a + b] for a, b in zip(s, n)]
            c = np.array([known.get(x, 0) for x in words], np.int64)[code] if words else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(t.first))
            hot = c > 0
            logs = np.bincount(doc[hot], np.log10(c[hot] + ALPHA), len(at) - 1)
            met = np.bincount(doc[hot], minlength=len(at) - 1)
            # other words: a row per (text, word); a text's own row has a key that is no word
            pair, times = np.unique(doc[~hot] * max(1, len(words)) + code[~hot], return_counts=True)
            d, k = (pair // max(1, len(words))), (pair % max(1, len(words)))
            m, ids = len(at) - 1, batch.column(2)
            own = [b" %d" % i for i in ids.to_pylist()]
            index = pa.array(np.concatenate([np.arange(m), d]))
            pad = np.zeros(len(d))
            yield pa.RecordBatch.from_arrays([
                ids.take(index), pa.array([*own, *(words[i] for i in k.tolist())], pa.binary()),
                pa.array(np.concatenate([np.zeros(m, np.int64), times])),
                pa.array(np.concatenate([np.diff(at), pad]).astype(np.int64)),
                pa.array(np.concatenate([met, pad]).astype(np.int64)),
                pa.array(np.concatenate([logs, pad])), pa.array(np.concatenate([model, pad])),
                pa.array([*batch.column(0).to_pylist(), *[None] * len(d)], batch.schema.field("doc_id").type),
                pa.array([*batch.column(3).to_pylist(), *[None] * len(d)], pa.bool_()),
            ], ["row", "word", "times", "n_tokens", "met", "logs", "model", "doc_id", "held_out"])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    found = (numbered.select("doc_id", "text", "row", "held_out").mapInArrow(run, "row long, word binary, times long, n_tokens long, met long, logs double, model double, "
                              f"doc_id {kind}, held_out boolean"))
    pairs = pair_scores(numbered, cell_shares(counts), total // OWNED + 1, wide_words(counts, total))
    rare = counts.where(F.floor(F.log2("n") * 8) < least).select("word", "n")
    n = F.coalesce("n", F.lit(0))
    whole = found.join(rare, "word", "left").unionByName(
        pairs.select("row", (F.col("pairs") / math.log(10)).alias("model")), allowMissingColumns=True)
    done = (whole.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("met") + F.sum(F.when(n > 0, F.col("times")).otherwise(0))).alias("met"),
        (F.sum("logs") + F.sum(F.col("times") * F.log10(n + ALPHA))).alias("logs"), F.sum("model").alias("model")))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("met") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + end_log - F.col("n_tokens") * base_log).alias("base_score"),
        (F.col("logs") + F.col("model")).alias("score"))
