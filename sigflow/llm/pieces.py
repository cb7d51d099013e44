"""Splitting texts into tokenizer pieces with array operations.

The pattern is the public byte-level BPE one:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Its matches tile a text, so a text's pieces are given by their start marks:
every run of letters, numbers, others or white space starts a piece; the last
character of a white-space run before something else is a piece of its own,
or, being a plain space, joins what follows; a lone apostrophe that starts a
piece takes its suffix letters along.
"""

from __future__ import annotations

import functools

import numpy as np

LETTER, NUMBER, OTHER, WHITE = 0, 1, 2, 3


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, from the pattern library's own sets."""
    import regex
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for value, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
    return out


def decode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, their byte offsets and the end, texts' first code points
    and the end)."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    size = np.ones(len(points), np.uint8)
    for bound in (0x80, 0x800, 0x10000):
        size += points >= bound
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return points, at, np.searchsorted(at, offsets)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pieces of concatenated UTF-8 texts start;
    pieces never cross a text's end."""
    if not len(data):
        return np.zeros(0, np.int64)
    points, at, heads = decode(data, offsets)
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[heads] = True                       # also the end
    cut = np.zeros(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut |= first
    # white-space runs: their last character, if something of the same text follows
    last = np.flatnonzero((kind == WHITE) & cut[1:] & ~first[1:])
    cut[last] = True
    cut[last[points[last] == 0x20] + 1] = False
    # contractions
    mark = np.flatnonzero((points == 0x27) & cut[:n] & cut[1:])
    mark = mark[~first[mark + 1]]
    ahead = np.concatenate([points, np.zeros(3, np.uint32)])
    one, two = ahead[mark + 1], ahead[mark + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) \
        | ((one == ord("l")) & (two == ord("l")))
    pair &= ~first[np.minimum(mark + 2, n)]
    for found, length in ((mark[short], 1), (mark[pair], 2)):
        cut[found + 1] = False
        cut[found + 1 + length] = True
    return at[np.flatnonzero(cut[:n])]
