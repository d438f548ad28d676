"""Patched frame-of-reference blocks of unsigned 32-bit integers.

A block holds 256 values. Their minimum is subtracted and the differences are packed at
the width that a percentile of them needs; the larger ones keep their low bits in place
and are listed, position and whole difference, as exceptions behind the packed words.

Block: minimum u32, width u8, zero u8, exceptions u16, packed words, positions u8[],
differences u32[]. Value 8 * i + lane of a block is field i of that lane, so packing and
unpacking are 32 shifts over whole arrays. File: magic, blocks, then the footer: start of
each block u64[], key of each document i64[], null flags u8[], end of each document in
ids u64[]; last the trailer: blocks, documents, ids u64, crc32 of the footer u32, magic.
All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"TGPFOR01"
BLOCK, LANES = 256, 8
TRAILER = struct.Struct("<QQQI8s")
#: Blocks packed or unpacked at once.
RUN = 256


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 256) values below 2**width as (n, 8 * width) words."""
    n = len(values)
    fields = values.astype(np.uint32).reshape(n, 32, LANES).transpose(1, 0, 2).reshape(32, -1)  # a field of all blocks side by side
    words = np.zeros((width, n * LANES), np.uint32)
    for i in range(32 if width else 0):
        at, shift = divmod(i * width, 32)
        words[at] |= fields[i] << np.uint32(shift)
        if shift + width > 32:
            words[at + 1] |= fields[i] >> np.uint32(32 - shift)
    return words.reshape(width, n, LANES).transpose(1, 0, 2).reshape(n, -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    words = words.reshape(n, width, LANES).transpose(1, 0, 2).reshape(width, -1)
    out = np.zeros((32, n * LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32 if width else 0):
        at, shift = divmod(i * width, 32)
        part = words[at] >> np.uint32(shift)
        if shift + width > 32:
            part |= words[at + 1] << np.uint32(32 - shift)
        out[i] = part & mask
    return out.reshape(32, n, LANES).transpose(1, 0, 2).reshape(n, BLOCK)


def bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each value."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1).astype(np.float64))) + 1, 0).astype(np.int64)


def encode(values: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """One byte string per block; the length of ``values`` is a multiple of 256."""
    blocks = values.astype(np.uint32).reshape(-1, BLOCK)
    low = blocks.min(axis=1)
    gaps = blocks - low[:, None]
    rank = min(BLOCK - 1, int(percentile * BLOCK))
    widths = bits(np.partition(gaps, rank, axis=1)[:, rank])
    large = gaps > ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    counts = large.sum(axis=1)
    packed: list[bytes] = [b""] * len(blocks)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        words = pack(gaps[own] & np.uint32((1 << int(width)) - 1), int(width)).astype("<u4")
        for at, row in zip(own, words):
            packed[at] = row.tobytes()
    places, excess = np.nonzero(large)[1].astype(np.uint8).tobytes(), gaps[large].astype("<u4").tobytes()
    ends = np.cumsum(counts).tolist()
    return [
        struct.pack("<IBBH", lowest, width, 0, n) + words + places[end - n:end] + excess[4 * (end - n):4 * end]
        for lowest, width, n, words, end in zip(low.tolist(), widths.tolist(), counts.tolist(), packed, ends)
    ]


def decode(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Values of the blocks that begin at ``starts`` in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:, None] + np.arange(8)]
    low = np.ascontiguousarray(heads[:, :4]).view("<u4")[:, 0].astype(np.uint32)
    widths, counts = heads[:, 4].astype(np.int64), np.ascontiguousarray(heads[:, 6:8]).view("<u2")[:, 0].astype(np.int64)
    gaps = np.zeros((len(starts), BLOCK), np.uint32)
    for width in np.unique(widths[widths > 0]):
        own = np.flatnonzero(widths == width)
        size = 4 * LANES * int(width)
        words = np.frombuffer(b"".join([data[at:at + size] for at in (starts[own] + 8).tolist()]), "<u4").astype(np.uint32)
        gaps[own] = unpack(words.reshape(len(own), -1), int(width))
    places = list(zip((starts + 8 + 4 * LANES * widths).tolist(), counts.tolist()))
    at = np.frombuffer(b"".join([data[a:a + n] for a, n in places]), np.uint8)
    gaps[np.repeat(np.arange(len(starts)), counts), at] = np.frombuffer(b"".join([data[a + n:a + 5 * n] for a, n in places]), "<u4")
    return (gaps + low[:, None]).reshape(-1)


class Writer:
    """Streams documents' ids into a file; holds one run of blocks and the index."""

    def __init__(self, out, percentile: float = 0.9):
        self.out, self.percentile = out, percentile
        self.pending: list[np.ndarray] = []
        self.held = self.total = 0
        self.at = len(MAGIC)
        self.starts: list[int] = []
        self.keys: list[int | None] = []
        self.ends: list[int] = []
        out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        self.keys.append(key)
        self.ends.append(self.total)
        if self.held >= RUN * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        values = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        self.pending, self.held = [values[n:]], self.held - n
        for at in range(0, n, RUN * BLOCK):
            blocks = encode(values[at:min(n, at + RUN * BLOCK)], self.percentile)
            for block in blocks:
                self.starts.append(self.at)
                self.at += len(block)
            self.out.write(b"".join(blocks))

    def close(self) -> None:
        if self.held:
            last = self.pending[-1][-1] if len(self.pending[-1]) else 0
            fill = -self.held % BLOCK  # repeats the last value
            self.pending.append(np.full(fill, last, np.uint32))
            self.held += fill
            self._flush(self.held)
        footer = b"".join((
            np.array(self.starts, "<u8").tobytes(), np.array([k or 0 for k in self.keys], "<i8").tobytes(),
            np.array([k is None for k in self.keys], np.uint8).tobytes(), np.array(self.ends, "<u8").tobytes(),
        ))
        self.out.write(footer + TRAILER.pack(len(self.starts), len(self.keys), self.total, zlib.crc32(footer), MAGIC))


class Reader:
    """Documents of a file in order, or any range of ids by the block index."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        if size < len(MAGIC) + TRAILER.size:
            raise ValueError("not a token file: too short")
        source.seek(size - TRAILER.size)
        n_blocks, n_docs, self.total, check, magic = TRAILER.unpack(source.read(TRAILER.size))
        length = 8 * n_blocks + 17 * n_docs
        if magic != MAGIC or length + TRAILER.size + len(MAGIC) > size:
            raise ValueError("not a token file: bad trailer")
        self.data_end = size - TRAILER.size - length
        source.seek(self.data_end)
        footer = source.read(length)
        if zlib.crc32(footer) != check:
            raise ValueError("token file: the index does not match its checksum")
        self.starts = np.frombuffer(footer, "<u8", n_blocks).astype(np.int64)
        keys = np.frombuffer(footer, "<i8", n_docs, 8 * n_blocks)
        absent = np.frombuffer(footer, np.uint8, n_docs, 8 * (n_blocks + n_docs))
        self.keys = [None if a else int(k) for k, a in zip(keys, absent)]
        self.ends = np.frombuffer(footer, "<u8", n_docs, 8 * n_blocks + 9 * n_docs).astype(np.int64)

    def _blocks(self, first: int, last: int) -> np.ndarray:
        begin = int(self.starts[first])
        end = int(self.starts[last]) if last < len(self.starts) else self.data_end
        self.source.seek(begin)
        return decode(self.source.read(end - begin), self.starts[first:last] - begin)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids from ``start`` on; reads only the blocks that hold them."""
        if not n:
            return np.zeros(0, np.uint32)
        first = start // BLOCK
        return self._blocks(first, -(-(start + n) // BLOCK))[start - first * BLOCK:][:n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, start in the file and ids of each document, one run of blocks at a time."""
        held, at, block = np.zeros(0, np.uint32), 0, 0
        for key, end in zip(self.keys, self.ends.tolist()):
            parts, need = [held], end - at
            got = len(held)
            while got < need:
                run = self._blocks(block, min(block + RUN, len(self.starts)))
                block += RUN
                parts.append(run)
                got += len(run)
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield key, at, held[:need]
            held, at = held[need:], end
