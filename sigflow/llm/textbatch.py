"""Texts of an Arrow batch as one numpy byte buffer, cut into bounded slices.

Nothing here makes a Python string per word; the work is on whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8 << 20        # texts handled at once; a longer text is a slice of its own


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL is an empty text."""
    n = len(column)
    if column.null_count:
        column = column.fill_null(pa.scalar("", column.type))
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut into slices of at most ``limit`` bytes of text (one text at
    least), each with its (bytes, offsets)."""
    for batch in batches:
        data, offsets = texts(batch.column(batch.schema.get_field_index(text_col)))
        n, at = batch.num_rows, 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), n)
            yield (batch.slice(at, end - at), data[offsets[at]:offsets[end]],
                   offsets[at:end + 1] - offsets[at])
            at = end


def padded(data: np.ndarray, extra: int = 64) -> np.ndarray:
    return np.concatenate([data, np.zeros(extra, np.uint8)])


def word_view(buf: np.ndarray) -> np.ndarray:
    """Unaligned little-endian 64-bit loads: ``word_view(b)[i]`` is b[i:i+8]."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    h = (h ^ (h >> np.uint64(32))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def span_hashes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of a padded buffer. Spans of up to seven
    bytes give different hashes for different bytes."""
    words = word_view(buf)
    h = words[starts] & MASKS[np.minimum(lens, 8)]
    h ^= lens.astype(np.uint64) << np.uint64(56)
    rest = np.flatnonzero(lens > 8)
    at = 8
    h = mix(h * _MIX[0])          # odd factor and finaliser are bijective
    while len(rest):
        left = lens[rest] - at
        w = words[starts[rest] + at] & MASKS[np.minimum(left, 8)]
        h[rest] = mix((h[rest] ^ w) * _MIX[0] + np.uint64(at))
        rest, at = rest[left > 8], at + 8
    return h


def same_spans(buf: np.ndarray, a: np.ndarray, b: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether the spans starting at ``a`` and ``b`` hold equal bytes."""
    words = word_view(buf)
    same = (words[a] ^ words[b]) & MASKS[np.minimum(lens, 8)] == 0
    rest, at = np.flatnonzero(lens > 8), 8
    while len(rest):
        left = lens[rest] - at
        same[rest] &= (words[a[rest] + at] ^ words[b[rest] + at]) & MASKS[np.minimum(left, 8)] == 0
        rest, at = rest[left > 8], at + 8
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, code): the index of the first span of every distinct byte
    string, and every span's number among them. Hash equality is confirmed by
    comparing bytes; were two strings to share a hash, bytes decide."""
    import pandas as pd
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buf = padded(data)
    code, uniq = pd.factorize(span_hashes(buf, starts, lens))
    first = np.empty(len(uniq), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    lead = first[code]
    if not ((lens == lens[lead]).all() and same_spans(buf, starts, starts[lead], lens).all()):
        raw = data.tobytes()
        code, _ = pd.factorize(pd.Series([raw[s:s + n] for s, n in zip(starts, lens)], dtype=object))
        first = np.empty(code.max() + 1, np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return first, code


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of every span, concatenated."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, first word of every text and the end) of the runs of
    bytes that are not in ``gap`` (words ``[^\\x20\\x09-\\x0D]+`` by default) of
    concatenated texts; words end with their text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z."""
    return _LOWER[data]
