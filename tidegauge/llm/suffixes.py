"""Sorted suffix runs: front coding, and merging by a loser tree that never compares a known prefix.

A run is a byte string of entries in order. An entry holds the length of the prefix it
shares with the entry before, the rest of the suffix, what stands left of the suffix in
its text, and where it comes from. In the tree every contender carries the length of the
prefix it shares with the last winner: the longer one is smaller, equal ones are compared
from there on, and the loser keeps what was found out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

_HEAD = struct.Struct("<BBBqqi")


class Entry(NamedTuple):
    suffix: bytes
    left: bytes
    doc: int
    row: int
    pos: int


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, which is at least ``start``."""
    n = min(len(a), len(b))
    if start >= n or a[start] != b[start]:
        return start
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_coded(entries: list[Entry]) -> bytes:
    """One run of entries, which are sorted here; suffixes have at most 255 bytes."""
    out, before = [], b""
    for e in sorted(entries):
        shared = common(before, e.suffix)
        out.append(_HEAD.pack(shared, len(e.suffix) - shared, len(e.left), e.doc, e.row, e.pos))
        out.append(e.suffix[shared:])
        out.append(e.left)
        before = e.suffix
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[int, Entry]]:
    """Entries with the prefix length shared with the one before."""
    at, before, size = 0, b"", _HEAD.size
    while at < len(run):
        shared, rest, left, doc, row, pos = _HEAD.unpack_from(run, at)
        at += size
        before = before[:shared] + run[at:at + rest]
        at += rest
        yield shared, Entry(before, run[at:at + left], doc, row, pos)
        at += left


def merged(runs: list[bytes]) -> Iterator[tuple[int, Entry]]:
    """All entries in order of their suffixes, each with the prefix length shared with the one before."""
    sources = [decoded(r) for r in runs if r]
    if not sources:
        return
    width = 1 << max(0, (len(sources) - 1).bit_length())
    #: Per contender its entry (None: used up) and the prefix shared with the last winner.
    heads: list[Entry | None] = [None] * width
    known = [0] * width
    for i, source in enumerate(sources):
        known[i], heads[i] = next(source)
    known = [0] * width
    losers = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        s, t = x.suffix, y.suffix
        shared = common(s, t, known[a])
        if shared == len(s) or shared < len(t) and s[shared] < t[shared]:
            known[b] = shared
            return a, b
        known[a] = shared
        return b, a

    def build(node: int) -> int:
        if node >= width:
            return node - width
        won, losers[node] = play(build(2 * node), build(2 * node + 1))
        return won

    winner = build(1)
    while heads[winner] is not None:
        yield known[winner], heads[winner]
        following = next(sources[winner], None)
        if following is None:
            heads[winner] = None
        else:
            known[winner], heads[winner] = following
        node = (winner + width) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1
