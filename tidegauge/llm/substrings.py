"""Substring dedup: bytes under a 50-byte string that also starts in a document of smaller id.

1. A text equal to that of a smaller id is covered whole, and only one of equal texts goes on.
2. Of the 24-byte strings inside each 50-byte window the one of smallest hash is an anchor:
   equal windows have equal anchors, so only suffixes at anchors need sorting. Tasks
   exchange sorted, difference-coded runs of anchor fingerprints; those that occur in two
   documents set bits of a bitmap of bounded size.
3. Suffixes at anchors with a set bit, 50 bytes long and with the bytes to their left, are
   exchanged as sorted front-coded runs and merged by loser trees. Where neighbours share
   24 bytes or more, their windows are compared byte by byte, and windows that occur under
   a smaller id give intervals.
4. Intervals meet their texts, which are cut and digested.

Suffixes that no other document can match are not sorted: see the README for the figures.

Defined results: a null text counts as empty; a null id is larger than every other and is
never a source; rows of one id are no sources for each other; equal rows give equal
results; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.bitmaps import bit_of, id_bitmap, passing
from tidegauge.llm.suffixes import Entry, front_coded, merged
from tidegauge.session import materialize

LENGTH, GRAM = 50, 24
#: Bits of a fingerprint; suffixes of a run; least number of shares that runs are dealt to, and bytes of text for each further one.
FINGER, RUN, SHARES, SHARE_BYTES = 40, 40_000, 256, 32 << 20
#: Bits of the bitmap: 512 per document within these bounds.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Bytes that are hashed at once.
PIECE = 2 << 20
LAST = (1 << 63) - 1

U = np.uint64
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, np.uint64)
_M = [pow(0x9E3779B97F4A7C15, n, 1 << 64) for n in range(9)]


def _shifted(a: np.ndarray, b: np.ndarray, by: int, factor: int) -> np.ndarray:
    n = max(0, min(len(a), len(b) - by))
    return a[:n] * U(factor) + b[by:by + n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from each position on."""
    one = _BYTES[data]
    two = _shifted(one, one, 1, _M[1])
    four = _shifted(two, two, 2, _M[2])
    eight = _shifted(four, four, 4, _M[4])
    sixteen = _shifted(eight, eight, 8, _M[8])
    h = _shifted(sixteen, eight, 16, _M[8])
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29)) | U(1)


def _sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """Of every ``width`` neighbours the smallest or largest."""
    span, out = 1, values
    while 2 * span <= width:
        out = choose(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return choose(out[:-rest], out[rest:]) if rest else out


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and hash of every anchor; long texts are hashed in overlapping pieces."""
    pieces, bases, owners = [], [], []
    for k, text in enumerate(texts):
        for base in range(0, max(0, len(text) - length + 1), PIECE):
            pieces.append(text[base:base + PIECE + length - 1])
            bases.append(base)
            owners.append(k)
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    h, width = gram_hashes(data), length - gram + 1
    least = _sliding(h, width, np.minimum)[:len(data) - length + 1]
    window = np.zeros(len(data), bool)
    for end, size in zip(ends.tolist(), sizes.tolist()):
        window[end - size:end - length + 1] = True
    least = np.where(window[:len(least)], least, U(0))  # windows across texts choose nothing
    pad = np.zeros(width - 1, U)
    most = _sliding(np.concatenate((pad, least, pad)), width, np.maximum)
    at = np.flatnonzero(most == h)
    piece = np.searchsorted(ends, at, "right")
    # smallest hashes are small: spread again, as shares and bits are dealt by the upper bits
    return np.array(owners)[piece], at - (ends - sizes)[piece] + np.array(bases)[piece], h[at] * U(_M[1])


def _batches(batches: Iterator, mask: np.ndarray, size: int = 4 << 20) -> Iterator[tuple[list, list, list[bytes]]]:
    """doc, row and text of the rows that may be alive, a few megabytes at a time."""
    docs, rows, texts, held = [], [], [], 0
    for batch in batches:
        at = passing(mask, batch.column("bit").to_numpy(zero_copy_only=False))
        for k in at.tolist():
            text = batch.column("text")[k].as_py().encode()
            if len(text) >= LENGTH:
                docs.append(batch.column("doc")[k].as_py())
                rows.append(batch.column("row")[k].as_py())
                texts.append(text)
                held += len(text)
            if held >= size:
                yield docs, rows, texts
                docs, rows, texts, held = [], [], [], 0
    if texts:
        yield docs, rows, texts


def shares_of(size: int) -> int:
    """A power of two that grows with the bytes of text, so that a share does not."""
    return min(1 << 20, max(SHARES, 1 << max(0, (size // SHARE_BYTES)).bit_length()))


def shared_anchors(source: DataFrame, mask: np.ndarray, bits: int, shares: int = SHARES) -> np.ndarray:
    """Bitmap of the fingerprints that anchors of two documents have."""
    low = FINGER - shares.bit_length() + 1  # bits below the share

    def runs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, count = [], 0

        def flush():
            every = np.sort(np.concatenate(held))
            cuts = np.searchsorted(every, np.arange(shares + 1, dtype=U) << U(low))
            rows = [(s, np.diff(every[a:b] - (U(s) << U(low)), prepend=U(0)).astype("<u4").tobytes())
                    for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            held.clear()
            return pa.RecordBatch.from_pydict({"share": pa.array([s for s, _ in rows], pa.int32()), "run": pa.array([r for _, r in rows], pa.binary())})

        for docs, _, texts in _batches(batches, mask):
            owner, _, h = anchors(texts)
            ids = np.array(docs, np.int64)[owner]
            finger = h >> U(64 - FINGER)
            order = np.lexsort((ids, finger))
            finger, ids = finger[order], ids[order]
            new = np.ones(len(finger), bool)
            new[1:] = (finger[1:] != finger[:-1]) | (ids[1:] != ids[:-1])  # once per document
            held.append(finger[new])
            count += int(new.sum())
            if count >= 1 << 20:
                yield flush()
                count = 0
        if held:
            yield flush()

    chunk = bits // shares

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, parts = None, []

        def close():
            every = np.sort(np.concatenate(parts))
            twice = every[1:][every[1:] == every[:-1]]
            flags = np.zeros(chunk, np.uint8)
            flags[(twice >> U(low - chunk.bit_length() + 1)).astype(np.int64)] = 1
            return pa.RecordBatch.from_pydict({"share": pa.array([now], pa.int32()), "chunk": pa.array([np.packbits(flags).tobytes()], pa.binary())})

        for batch in batches:
            for share, run in zip(batch.column("share").to_pylist(), batch.column("run").to_pylist()):
                if share != now and parts:
                    yield close()
                    parts.clear()
                now = share
                parts.append(np.cumsum(np.frombuffer(run, "<u4").astype(U), dtype=U))
        if parts:
            yield close()

    exchanged = source.select("doc", "row", "bit", "text").mapInArrow(runs, "share int, run binary").repartition("share").sortWithinPartitions("share")
    flags = np.zeros(bits // 8, np.uint8)
    for r in exchanged.mapInArrow(merge, "share int, chunk binary").toLocalIterator():  # bits / 8 bytes in all
        flags[r.share * chunk // 8:(r.share + 1) * chunk // 8] = np.frombuffer(r.chunk, np.uint8)
    return flags


def compared(group: list[Entry], length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) for the windows of a group, equal in their first bytes, that occur under a smaller id."""
    contexts: dict[tuple[bytes, bytes], list[Entry]] = {}
    for e in group:
        contexts.setdefault((e.left, e.suffix), []).append(e)
    if len(contexts) == 1:  # all windows are shared by all
        least = min(e.doc for e in group)
        for e in group:
            if e.doc > least and len(e.left) + len(e.suffix) >= length:
                yield e.row, e.pos - len(e.left), e.pos + len(e.suffix)
        return
    first: dict[bytes, int] = {}
    for (left, suffix), entries in contexts.items():
        text, doc = left + suffix, min(e.doc for e in entries)
        for i in range(min(len(left), len(text) - length) + 1):
            window = text[i:i + length]
            if first.get(window, LAST + 1) > doc:
                first[window] = doc
    for (left, suffix), entries in contexts.items():
        text = left + suffix
        found = [first[text[i:i + length]] for i in range(min(len(left), len(text) - length) + 1)]
        for e in entries:
            start = None
            for i, doc in enumerate(found):
                if doc < e.doc:
                    start = i if start is None else start
                elif start is not None:
                    yield e.row, e.pos - len(left) + start, e.pos - len(left) + i - 1 + length
                    start = None
            if start is not None:
                yield e.row, e.pos - len(left) + start, e.pos - len(left) + len(found) - 1 + length


def intervals(source: DataFrame, mask: np.ndarray, flags: np.ndarray, shares: int = SHARES) -> DataFrame:
    """(row, start, end) of repeated bytes, from merged suffix runs."""
    shift, top, margin = U(64 - (8 * len(flags)).bit_length() + 1), U(64 - shares.bit_length() + 1), LENGTH - GRAM

    def runs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, list[Entry]] = {}
        count = 0

        def flush():
            rows = [(s, front_coded(e)) for s, e in held.items()]
            held.clear()
            return pa.RecordBatch.from_pydict({"share": pa.array([s for s, _ in rows], pa.int32()), "run": pa.array([r for _, r in rows], pa.binary())})

        for docs, ids, texts in _batches(batches, mask):
            owner, pos, h = anchors(texts)
            bit = (h >> shift).astype(np.int64)
            kept = np.flatnonzero((flags[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
            for k, p, share in zip(owner[kept].tolist(), pos[kept].tolist(), (h[kept] >> top).tolist()):
                text = texts[k]
                held.setdefault(share, []).append(Entry(text[p:p + LENGTH], text[max(0, p - margin):p], docs[k], ids[k], p))
                count += 1
            if count >= RUN:
                yield flush()
                count = 0
        if held:
            yield flush()

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, parts = None, []

        def close():
            out, group = [], []
            for shared, entry in merged(parts):
                if shared < GRAM and group:
                    if len(group) > 1 and any(e.doc != group[0].doc for e in group):
                        out.extend(compared(group))
                    group = []
                group.append(entry)
            if len(group) > 1:
                out.extend(compared(group))
            row, start, end = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_pydict({"row": pa.array(row, pa.int64()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32())})

        for batch in batches:
            for share, run in zip(batch.column("share").to_pylist(), batch.column("run").to_pylist()):
                if share != now and parts:
                    yield close()
                    parts.clear()
                now = share
                parts.append(run)
        if parts:
            yield close()

    exchanged = source.select("doc", "row", "bit", "text").mapInArrow(runs, "share int, run binary").repartition("share").sortWithinPartitions("share")
    return exchanged.mapInArrow(merge, "row bigint, start int, end int")


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted or unsorted intervals."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The texts with a ``row`` key, and (row, spans) of those that lose bytes."""
    body = F.coalesce(docs[text], F.lit(""))
    source = docs.select(docs[key].cast("bigint").alias("doc_id"), body.alias("text")).withColumn("row", F.xxhash64("doc_id", F.md5("text")))
    source = source.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("bit", bit_of(F.col("row")))
    narrow = materialize(source.select("doc", "row", "bit", F.md5("text").alias("sum"), F.octet_length("text").alias("size")), "substring-rows")
    firsts = narrow.where(F.col("size") >= LENGTH).groupBy("sum", "size").agg(F.min("doc").alias("first"))
    copies = narrow.join(firsts, ["sum", "size"]).where("doc > first").select("row", F.lit(0).alias("start"), F.col("size").cast("int").alias("end"))
    alive = narrow.join(copies.select("row"), "row", "left_anti")
    mask = id_bitmap(alive.select("bit"))
    n, size = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits, shares = min(MOST_BITS, max(LEAST_BITS, 1 << (512 * n).bit_length())), shares_of(size)
    found = intervals(source, mask, shared_anchors(source, mask, bits, shares), shares)
    every = materialize(found.union(copies).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "substring-spans")
    return source.select("doc_id", "row", "text"), every


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept`` (the remaining bytes)."""
    source, spans = repeated_spans(docs, text, key)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for body, cut in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    data, runs = body.encode(), union_of([(s["start"], s["end"]) for s in cut or ()])
                    ends = [0, *(x for r in runs for x in r), len(data)]
                    left = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])) if runs else data
                    rows.append((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
                size, gone, n, digest, left = zip(*rows)
                columns = {
                    "doc_id": part.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                    "n_spans": pa.array(n, pa.int64()), "kept_sha256": pa.array(digest),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(left, pa.binary())} if keep_text else {}))

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    return source.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, schema).withColumnRenamed("doc_id", key)
