"""Sampled suffixes of texts: rolling hashes and window minima."""

from __future__ import annotations

import functools

import numpy as np

from sigflow.llm.textbatch import mix


@functools.lru_cache(1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240)
    return (rng.integers(0, 2**64, 256, dtype=np.uint64), rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1))


def rolling(data: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Hashes of all runs of the given sizes (powers of two), by doubling: a
    run's hash is made of those of its two halves."""
    table, odd = _factors()
    h, size, level, out = table[data], 1, 0, {}
    while True:
        if size in sizes:
            out[size] = h
        if size >= max(sizes):
            return out
        h = h[:-size] * odd[level] + h[size:] if len(h) > size else h[:0]
        size, level = 2 * size, level + 1


def block(length: int) -> int:
    """The largest power of two up to ``length``."""
    return 1 << (length.bit_length() - 1)


def span_hash(runs: np.ndarray, size: int, starts: np.ndarray, lens: np.ndarray, most: int) -> np.ndarray:
    """Hashes of spans of ``size`` to ``most`` bytes from the run hashes of
    ``size`` bytes at evenly spaced places that together cover a span."""
    count = max(2, -(-most // size))
    h = mix(lens.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    for j in range(count):
        h = mix((h ^ runs[starts + (lens - size) * j // (count - 1)]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
    return h


def sampled(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """One sampled suffix for each run of windows of ``length`` bytes that have
    it: (text, place, first and last window start, hash of the suffix's first
    ``gram`` bytes, hash of all the windows together). Places count from the
    text's start.

    A window's sample is the place of its least gram hash, the leftmost of
    equals: equal windows have it at the same distance from their start, and
    every window of a text has exactly one."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    n = len(data)
    ends = np.diff(offsets) - length + 1
    if n < length or not (ends > 0).any():
        return none
    unit = block(length)
    runs = rolling(data, [gram, unit])
    bits = np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = mix(runs[gram] * np.uint64(0xD6E8FEB86659FD93))
    order = (order & ~low) | np.arange(len(order), dtype=np.uint64)
    width = length - gram + 1
    cells = np.full(-(-len(order) // width) * width, np.uint64(2**64 - 1))
    cells[:len(order)] = order
    cells = cells.reshape(-1, width)
    ahead = np.minimum.accumulate(cells, axis=1).reshape(-1)
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:n - length + 1], ahead[width - 1:width + n - length])
    valid = np.zeros(n + 1, np.int8)
    some = np.flatnonzero(ends > 0)
    valid[offsets[some]] += 1
    valid[offsets[some] + ends[some]] -= 1
    s = np.flatnonzero(np.cumsum(valid[:n - length + 1]))
    place = (least[s] & low).astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    first, last, place = s[lead], s[np.append(lead[1:], len(s)) - 1], place[lead]
    text = np.searchsorted(offsets, first, "right") - 1
    whole = span_hash(runs[unit], unit, first, last - first + length, 2 * length - gram)
    base = offsets[text]
    return text, place - base, first - base, last - base, runs[gram][place], whole
