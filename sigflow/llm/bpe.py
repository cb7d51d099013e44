"""Byte-level BPE encoding and decoding with numpy matrices.

The distinct pieces of a slice of texts are put into matrices of one row per
piece, bucketed by length and padded. In every round each row merges its
leftmost pair of minimum rank: pair ranks come from a hash table over (left,
right), kept beside the tokens so that a round looks up only the two pairs
that changed; the merged column is then squeezed out of every row. Rows
without a mergeable pair leave the matrix.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.common import text_of
from sigflow.llm.pieces import piece_starts
from sigflow.llm.textbatch import distinct_spans, ragged, slices

WIDTHS = [*range(2, 17), 18, 20, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256, 512, 1024, 2048]
CELLS = 1 << 20              # cells of one matrix


class Bpe:
    """Tokens as bytes, the id of every single byte and merges
    {(left id, right id): (rank, merged id)}. ``whole``: a piece that is
    itself a token is that token, whatever the merges give."""

    def __init__(self, tokens: list[bytes], merges: dict, whole: bool):
        self.tokens = tokens
        lens = np.array([len(t) for t in tokens], np.int64)
        self.bytes, self.size = np.frombuffer(b"".join(tokens), np.uint8), lens
        self.start = np.cumsum(lens) - lens
        by = {t: i for i, t in enumerate(tokens) if len(t) == 1}
        value = np.array(list(merges.values()), np.int64).reshape(-1, 2)
        # ids and ranks in two bytes where they fit; `none` is no rank and padding
        small = max(len(tokens), int(value[:, 0].max(initial=0)) + 1) < 65535
        self.narrow, self.wide = (np.uint16, np.uint32) if small else (np.uint32, np.uint64)
        self.none = self.narrow(65535 if small else 2**32 - 1)
        self.factor = self.wide(0x9E3779B1 if small else 0x9E3779B97F4A7C15)
        self.byte = np.array([by[bytes([b])] for b in range(256)], self.narrow)
        self.result = np.zeros(int(value[:, 0].max(initial=0)) + 1, self.narrow)
        self.result[value[:, 0]] = value[:, 1]
        pair = np.array(list(merges), np.int64).reshape(-1, 2).astype(self.narrow)
        self._fill(pair[:, 0], pair[:, 1], value[:, 0].astype(self.narrow))
        self.pairs = self.ranks(np.repeat(self.byte, 256), np.tile(self.byte, 256))
        self.odd: dict[bytes, int] = {}
        if whole:      # tokens that the merges do not build
            at, n = self.start, self.size
            flat, off, count = self._encode(self.bytes, at, n)
            off = off[count == 1], np.flatnonzero(count == 1)
            right = np.zeros(len(tokens), bool)
            right[off[1]] = flat[off[0]] == off[1]
            self.odd = {tokens[i]: int(i) for i in np.flatnonzero(~right) if tokens[i]}

    def _fill(self, left: np.ndarray, right: np.ndarray, ranks: np.ndarray) -> None:
        keys, self.shift = self._keys(left, right), None
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, size = self.wide(8 * keys.itemsize - bits), 1 << bits
        self.slot_key = np.full(size + 64, self.wide(-1 % 2**(8 * keys.itemsize)))
        self.slot_rank = np.full(size + 64, self.none)
        todo = np.arange(len(keys))
        place = ((keys * self.factor) >> self.shift).astype(np.int64)
        while len(todo):                           # linear probing, all keys at once
            free = self.slot_rank[place[todo]] == self.none
            spot, who = np.unique(place[todo[free]], return_index=True)
            who = todo[free][who]
            self.slot_key[spot], self.slot_rank[spot] = keys[who], ranks[who]
            todo = np.setdiff1d(todo, who, assume_unique=True)
            place[todo] += 1

    def _keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(self.wide) << self.wide(8 * self.narrow().itemsize) | b

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, ``none`` where there is no merge (padding has
        no merges)."""
        key = self._keys(a, b)
        place = (key * self.factor) >> self.shift
        held, out = self.slot_key[place], self.slot_rank[place]
        todo = np.flatnonzero((held != key) & (out != self.none))
        out[todo] = self.none
        place = place.astype(np.int64)
        while len(todo):
            place[todo] += 1
            held, rank = self.slot_key[place[todo]], self.slot_rank[place[todo]]
            hit = held == key[todo]
            out[todo[hit]] = rank[hit]
            todo = todo[~hit & (rank != self.none)]
        return out

    def _rounds(self, m: np.ndarray, r: np.ndarray, rows: np.ndarray, done: list) -> None:
        while True:
            width = m.shape[1]
            if width == 1:
                done.append((rows, m))
                return
            at = r.argmin(1)
            least = r[np.arange(len(r)), at]
            over = least == self.none
            if over.any():
                done.append((rows[over], m[over]))
                go = ~over
                m, r, rows, at, least = m[go], r[go], rows[go], at[go], least[go]
            k = len(m)
            if not k:
                return
            line = np.arange(k)
            m[line, at] = self.result[least]
            keep = np.ones((k, width), bool)
            keep[line, at + 1] = False
            m = m[keep].reshape(k, width - 1)
            if width == 2:
                continue
            keep = np.ones((k, width - 1), bool)
            keep[line, at] = False
            r = r[keep].reshape(k, width - 2)
            has = np.flatnonzero(at > 0)
            r[has, at[has] - 1] = self.ranks(m[has, at[has] - 1], m[has, at[has]])
            has = np.flatnonzero(at < width - 2)
            r[has, at[has]] = self.ranks(m[has, at[has]], m[has, at[has] + 1])

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order for a piece beyond the widest
        matrix, whose rounds would each cost its whole length: a heap of
        (rank, position) over a linked list."""
        none, n = int(self.none), len(ids)
        cells = lambda x: np.array(x, self.narrow)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        now = [*self.ranks(cells(ids[:-1]), cells(ids[1:])).tolist(), none]   # rank of (i, next); -1: merged away
        heap = [(rank, i) for i, rank in enumerate(now) if rank != none]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if now[i] != rank:
                continue
            j = after[i]
            ids[i], after[i], now[j] = int(self.result[rank]), after[j], -1
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    now[k] = int(self.ranks(cells([ids[k]]), cells([ids[after[k]]]))[0]) if after[k] >= 0 else none
                    if now[k] != none:
                        heapq.heappush(heap, (now[k], k))
        return [t for t, state in zip(ids, now) if state != -1]

    def _encode(self, data, starts, lens):
        count, done = np.ones(len(starts), np.int64), []
        order = np.argsort(lens, kind="stable")
        sorted_lens, low = lens[order], 0
        for width in WIDTHS:
            high = int(np.searchsorted(sorted_lens, width, "right"))
            step = max(1, CELLS // width)
            for at in range(low, high, step):
                rows = order[at:min(at + step, high)]
                m = np.full((len(rows), width), self.none)
                cell = np.arange(width) < lens[rows][:, None]
                raw = np.zeros(m.shape, np.uint8)
                raw[cell] = data[ragged(starts[rows], lens[rows])]
                m[cell] = self.byte[raw[cell]]
                # the first ranks are those of byte pairs: a small direct table
                r = self.pairs[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
                r[~cell[:, 1:]] = self.none
                self._rounds(m, r, rows, done)
            low = high
        for i in order[low:]:
            ids = self._long(self.byte[data[starts[i]:starts[i] + lens[i]]].tolist())
            done.append((np.array([i]), np.array([ids], self.narrow)))
        for rows, m in done:
            count[rows] = (m != self.none).sum(1)
        off = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), self.narrow)
        for rows, m in done:
            flat[ragged(off[rows], count[rows])] = m[m != self.none]
        return flat, off, count

    def encode(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray):
        """(ids, offset, count) of pieces given as spans of ``data``."""
        flat, off, count = self._encode(data, starts, lens)
        if self.odd:
            longest = max(map(len, self.odd))
            raw = data.tobytes()
            flat = [flat]
            size = len(flat[0])
            for i in np.flatnonzero((count > 1) & (lens <= longest)):
                token = self.odd.get(raw[starts[i]:starts[i] + lens[i]])
                if token is not None:
                    off[i], count[i] = size, 1
                    flat.append(np.array([token], self.narrow))
                    size += 1
            flat = np.concatenate(flat)
        return flat, off, count

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of every text and the end)."""
        starts = piece_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, self.narrow), np.zeros(len(offsets), np.int64)
        lens = np.diff(np.append(starts, len(data)))
        first, code = distinct_spans(data, starts, lens)
        flat, off, count = self.encode(data, starts[first], lens[first])
        each = count[code]
        ids = flat[ragged(off[code], each)]
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(each, out=total[1:])
        return ids, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        return self.bytes[ragged(self.start[ids], self.size[ids])]


@functools.lru_cache(4)
def from_ranks(file: bytes) -> Bpe:
    """From a rank file (a line: token in base64, rank): a pair merges when its
    bytes together are a token, whose rank is the pair's."""
    rank = {base64.b64decode(t): int(r) for t, r in (line.split() for line in file.splitlines() if line)}
    tokens = [b""] * (max(rank.values()) + 1)
    for t, r in rank.items():
        tokens[r] = t
    merges = {(rank[t[:i]], rank[t[i:]]): (r, r) for t, r in rank.items() for i in range(1, len(t))
              if t[:i] in rank and t[i:] in rank}
    return Bpe(tokens, merges, whole=True)


@functools.lru_cache(4)
def from_json(file: bytes) -> Bpe:
    """From a ``tokenizers`` file of byte-level BPE: merges rank by their order."""
    model = json.loads(file)["model"]
    # fixed values: printable bytes stand for themselves, the others for 256, 257, ...
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = model["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        if all(c in byte for c in t):
            tokens[i] = bytes(byte[c] for c in t)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
    return Bpe(tokens, merges, whole=False)


@functools.lru_cache(4)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal digits and a comma for ids below n: padded, used cells, length."""
    texts = [f"{i},".encode() for i in range(n)]
    width = max(map(len, texts))
    cells = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(n, width)
    return cells, cells != 0, np.array([len(t) for t in texts], np.int64)


def bpe_digests(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text by the rank file, decode its ids again, and
    return per row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A NULL or empty text has no token. Rows keep their number, repeated ones
    included; no row depends on another, a NULL id stays NULL, an empty table
    gives an empty result and other columns are not read. Texts are handled in
    slices of a few MB, so memory does not depend on the table; a single text
    is held whole."""
    spark = df.sparkSession
    with open(ranks_path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())      # the vocabulary, under 1 MB
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = from_ranks(file.value)
        cells, used, size = _decimals(len(bpe.tokens))
        for batch, data, offsets in slices(batches):
            ids, at = bpe.encode_texts(data, offsets)
            text = cells[ids][used[ids]].tobytes()
            end = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(size[ids], out=end[1:])
            back = bpe.decode(ids).tobytes()
            byte = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(bpe.size[ids], out=byte[1:])
            e, b = end[at], byte[at]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(at), pa.int64()),
                pa.array([hashlib.sha256(text[x:max(x, y - 1)]).hexdigest() for x, y in zip(e[:-1], e[1:])], pa.string()),
                pa.array([hashlib.sha256(back[x:y]).hexdigest() for x, y in zip(b[:-1], b[1:])], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
