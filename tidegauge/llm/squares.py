"""Online detection of squares, and the runs they merge into, by dyadic catchers.

Words are appended in pieces of any size. When a block of 2**k words that starts at a
multiple of 2**k is complete it becomes a catcher: for every word appended while it is
within reach it compares the suffix of 2**k words that ends there with its block, by the
names of both (64-bit hashes that double in length from level to level). A square of
period p holds such a block of at least a quarter of p words in its first half, so each
level watches the periods that its length answers for, with at most two catchers a word.

Where the next block matches at the same distance the catch goes on; where it does not,
the catch is closed, its ends are found by halving steps over the shorter names, and if
the words that agree are at least as many as the period, the squares seen are one run.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of two neighbours; not linear, so that no kind of text has equal names by rule."""
    h = (a ^ (b >> U(32))) * U(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def plan(least: int, longest: int) -> list[tuple[int, int, int]]:
    """(block length, smallest and largest period) of every level for sequences of at most ``longest`` words.

    The words that agree with those p further on are p or more, and least - p or more;
    a stretch of 2m - 1 words holds a whole block of m.
    """
    levels: list[tuple[int, int, int]] = []
    for p in range(1, longest // 2 + 1):
        if levels and p > least and p <= levels[-1][2]:
            continue
        agree = max(p, least - p)
        m = 1 << ((agree + 1) // 2).bit_length() - 1
        if p > least // 2 and p == 2 * m - 1:
            levels.append((m, p, 4 * m - 2))  # from here on a level spans all periods of its block
        elif not levels or levels[-1][2] < p:
            if levels and levels[-1][0] == m:
                levels[-1] = (m, levels[-1][1], p)
            else:
                levels.append((m, p, p))
    return levels


class Catchers:
    """Runs of a growing sequence of at most ``most`` words, in which no square is longer than ``longest``."""

    def __init__(self, most: int, longest: int | None = None, least: int = 12):
        self.least, self.n = least, 0
        self.levels = plan(least, min(most, longest or most))
        top = max([m for m, _, _ in self.levels], default=1).bit_length()
        self.names = [np.empty(most, U) for _ in range(top)]
        self.named = [0] * top
        #: Per level the next suffix to compare, and the open catches: period, first and last block, start (-1: not known).
        self.compared = [0] * len(self.levels)
        self.open = [np.empty((4, 0), np.int64) for _ in self.levels]
        self.found: list[np.ndarray] = []

    def append(self, codes: np.ndarray) -> None:
        self.names[0][self.n:self.n + len(codes)] = codes
        self.n += len(codes)
        self.named[0] = self.n
        for k in range(1, len(self.names)):
            half, a, b = 1 << k - 1, self.named[k], max(0, self.n - (1 << k) + 1)
            if a < b:
                below = self.names[k - 1]
                self.names[k][a:b] = mixed(below[a:b], below[a + half:b + half])
                self.named[k] = b
        for at in range(len(self.levels)):
            self._advance(at, False)

    def runs(self) -> np.ndarray:
        """All runs so far, as rows of start, end and smallest period, by start and period."""
        for at in range(len(self.levels)):
            self._advance(at, True)
        every = np.concatenate(self.found, axis=1) if self.found else np.empty((3, 0), np.int64)
        every = every[:, np.lexsort((every[2], every[1], every[0]))]
        new = np.ones(every.shape[1], bool)  # multiples of a period give the same stretch
        new[1:] = (every[0, 1:] != every[0, :-1]) | (every[1, 1:] != every[1, :-1])
        every = every[:, new]
        return every[:, np.lexsort((every[2], every[0]))].T

    def _hits(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Periods and blocks of the catchers that the words since the last call have met again."""
        m, low, high = self.levels[at]
        names, periods, places = self.names[m.bit_length() - 1], [], []
        done, ready = self.compared[at], max(0, self.n - m + 1)
        for back in range((high - low + m) // m):
            first = max(done, low + back * m)
            if first >= ready:
                break
            suffix = np.arange(first, ready)
            block = ((suffix - low) & -m) - back * m
            hit = np.flatnonzero(names[first:ready] == names[block])
            p = suffix[hit] - block[hit]
            near = p <= high
            periods.append(p[near])
            places.append(block[hit][near])
        self.compared[at] = max(done, ready)
        empty = np.empty(0, np.int64)
        return np.concatenate(periods) if periods else empty, np.concatenate(places) if places else empty

    def _advance(self, at: int, last: bool) -> None:
        m = self.levels[at][0]
        p, block = self._hits(at)
        period, first, end, start = np.concatenate((self.open[at], np.stack((p, block, block, np.full(len(p), -1)))), axis=1)
        self.open[at] = np.empty((4, 0), np.int64)
        if not len(period):
            return
        order = np.lexsort((first, period))
        period, first, end, start = period[order], first[order], end[order], start[order]
        new = np.ones(len(period), bool)
        new[1:] = (period[1:] != period[:-1]) | (first[1:] != end[:-1] + m)
        heads = np.flatnonzero(new)
        tails = np.concatenate((heads[1:], [len(period)])) - 1
        period, first, end, start = period[heads], first[heads], end[tails], start[heads]
        fresh = start < 0
        start = np.where(fresh, self._leftward(first, period, m, fresh), start)
        closed = np.full(len(period), last) | (end + 2 * m + period <= self.n)
        self.open[at] = np.stack((period, first, end, start))[:, ~closed]
        period, start = period[closed], start[closed]
        stop = self._rightward(end[closed] + m, period, m)
        square = (stop - start >= period) & (stop - start + period >= self.least)
        if square.any():
            self.found.append(np.stack((start, stop + period, period))[:, square])

    def _leftward(self, start: np.ndarray, period: np.ndarray, m: int, wanted: np.ndarray) -> np.ndarray:
        start = start.copy()
        for k in reversed(range(m.bit_length() - 1)):
            step = 1 << k
            some = np.flatnonzero(wanted & (start >= step))
            i = start[some] - step
            start[some[self.names[k][i] == self.names[k][i + period[some]]]] -= step
        return start

    def _rightward(self, stop: np.ndarray, period: np.ndarray, m: int) -> np.ndarray:
        stop = stop.copy()
        for k in reversed(range(m.bit_length() - 1)):
            step = 1 << k
            some = np.flatnonzero(stop + step + period <= self.n)
            i = stop[some]
            stop[some[self.names[k][i] == self.names[k][i + period[some]]]] += step
        return stop
