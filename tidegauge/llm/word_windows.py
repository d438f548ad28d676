"""Word codes that are equal on every machine, and the anchors of windows of words."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BYTES = np.random.Generator(np.random.PCG64(12)).integers(1, 1 << 63, 256, np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once.
PIECE = 1 << 20


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair."""
    return stirred((a ^ (b >> U(32))) * U(_FACTOR) + b)


def word_codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word, never 0."""
    out, at = np.empty(len(words), U), 0
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    while at < len(words):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PIECE, "right")))
        data = np.frombuffer(b"".join(words[at:to]), np.uint8)
        start = ends[at:to] - sizes[at:to] - before
        power = np.cumprod(np.full(int(sizes[at:to].max()), _FACTOR, U))
        offset = np.arange(len(data)) - np.repeat(start, sizes[at:to])
        out[at:to] = np.add.reduceat(_BYTES[data] * power[offset], start)
        at = to
    return stirred(out) | U(1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Of every ``width`` neighbours the smallest."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(codes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are smallest in some window: equal windows have equal ones at equal places.

    ``gram`` is a power of two. All places of a smallest value within a window are taken.
    """
    if len(codes) < window:
        return np.empty(0, np.int64), np.empty(0, U)
    h, span = codes, 1
    while span < gram:
        h = joined(h[:-span], h[span:])
        span *= 2
    width = window - gram + 1
    least = sliding_least(h, width)
    pad = np.zeros(width - 1, U)
    most = ~sliding_least(~np.concatenate((pad, least, pad)), width)
    at = np.flatnonzero(most == h)
    return at, h[at]
