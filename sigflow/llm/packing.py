"""Packing documents into token sequences of bounded length.

A document's ids are cut at multiples of the sequence length. A full piece is
a sequence of its own; the rests are packed by first-fit decreasing inside
randomised groups of bounded size, each group on its own. Finding the first
sequence with room descends a tournament tree over the free capacities: every
inner node holds the larger of its children, so a step left or right costs one
comparison. Only lengths and checksums are shuffled, never ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.bpe import from_json
from sigflow.llm.common import materialise, text_of
from sigflow.llm.textbatch import ragged, slices

GROUP_PIECES = 4096          # pieces packed together, on average
SEED = 42


class Tournament:
    """Free capacities of ``n`` bins; ``place`` gives the first with room."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """(bin, what it already held) of the first bin with ``size`` free."""
        tree, at = self.tree, 1
        if tree[1] < size:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        found, held = at - self.leaves, self.capacity - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
        return found, held


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item; larger items first, ties in the given order."""
    tree = Tournament(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], offsets[i] = tree.place(int(sizes[i]))
    return bins, offsets


def token_pieces(df: DataFrame, tokenizer_path: str, length: int, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut at multiples
    of ``length``."""
    with open(tokenizer_path, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())     # the vocabulary, under 2 MB
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = from_json(file.value)
        for batch, data, offsets in slices(batches):
            ids, at = bpe.encode_texts(data, offsets)
            at = at + np.arange(len(at))
            full = np.full(int(at[-1]), end_id, "<u4")
            keep = np.ones(len(full), bool)
            keep[at[1:] - 1] = False
            full[keep] = ids
            tokens = np.diff(at)
            count = -(-tokens // length)
            doc = np.repeat(np.arange(len(tokens)), count)
            start = ragged(np.zeros(len(tokens), np.int64), count) * length
            size = np.minimum(tokens[doc] - start, length)
            raw, low = memoryview(full.tobytes()), (at[doc] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(low, low + 4 * size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()),
                 pa.array(tokens[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, length: int, group_pieces: int = GROUP_PIECES, seed: int = SEED) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to
    ``length``. Sequences are gapless from offset 0 and their ids unique: odd
    for full pieces, even for packed groups."""
    pieces = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    rests = pieces.where(F.col("length") < length)
    groups = max(1, -(-rests.count() // group_pieces))
    out = "doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset".split(", ")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        bins, offset = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=2 * ((int(key[0]) << 32) + bins), offset=offset)[out]

    kind = pieces.schema["doc_id"].dataType.simpleString()
    packed = (rests.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), F.col("row")), F.lit(groups)))
              .groupBy("group").applyInPandas(
                  run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                       "sequence_id long, offset long"))
    alone = pieces.where(F.col("length") == length).select(
        *out[:5], (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(df: DataFrame, tokenizer_path: str, length: int = 1024, id_col: str = "doc_id",
                   text_col: str = "text", group_pieces: int = GROUP_PIECES, seed: int = SEED) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` ids.

    A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A NULL or empty text is the single end id. Every row of ``df``,
    repeated ones and those with a NULL id included, is a document of its own;
    equal lengths are placed in input order. An empty table gives an empty
    result; other columns are not read. A group holds about ``group_pieces``
    pieces whatever the table's size, as rows are dealt by a hash of their
    number; sequences with little room left stay unpadded only at a power of
    two, so the rest of a sequence is padding."""
    return pack(token_pieces(df, tokenizer_path, length, 0, id_col, text_col), length, group_pieces, seed)
