"""Periodic runs of words in every text, found online, and texts without their repetitions.

A run is a stretch of words with smallest period q whose length is ``least`` words and
two periods or more, and that no neighbouring word extends. Texts are appended to
``squares.Catchers`` piece by piece; short texts share one stream, between them stands a
code that no word and no other gap has. No row is moved to another task.

Words are the maximal runs of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return; they are told apart by 64-bit hashes.

Defined results: a null or empty text has no word, no run, and collapses to the empty
text; every row is judged by itself, so repeated rows and null keys are kept; the memory
of a task grows with its longest text (about 8 bytes a word and level), not with the
number of texts; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.squares import Catchers

#: Words of a stream of short texts, words of a short text, words appended at once.
STREAM, SHORT, PIECE = 1 << 17, 1 << 12, 1 << 16

U = np.uint64


def _stream(texts: list[list[bytes]], least: int) -> list[np.ndarray]:
    """Runs (start, length, period) of each list of words."""
    sizes = np.array([len(w) for w in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.empty(int(sizes.sum()) + len(texts), U)
    for k, words in enumerate(texts):
        at = starts[k]
        codes[at:at + len(words)] = np.fromiter(map(hash, words), np.int64, len(words)).view(U)
        codes[at + len(words)] = k  # differs from every other gap
    catchers = Catchers(len(codes), int(sizes.max()), least)
    for at in range(0, len(codes), PIECE):
        catchers.append(codes[at:at + PIECE])
    start, end, period = catchers.runs().T
    owner = np.searchsorted(starts, start, "right") - 1
    rows = np.stack((start - starts[owner], end - start, period), axis=1)
    return np.split(rows, np.searchsorted(owner, np.arange(1, len(texts))))


def runs_of(texts: list[list[bytes]], least: int = 12) -> list[np.ndarray]:
    """Runs (start, length, period) of each list of words, by start and period."""
    out: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(texts)
    short = [k for k, w in enumerate(texts) if least <= len(w) <= SHORT]
    for group in [short] * bool(short) + [[k] for k, w in enumerate(texts) if len(w) > max(SHORT, least - 1)]:
        for k, rows in zip(group, _stream([texts[k] for k in group], least)):
            out[k] = rows
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but for those of a run after its first period, joined by blanks."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 12) -> DataFrame:
    """key, ``n_words``, ``runs`` (start, length, period, by start and period) and ``collapsed`` (the text without repetitions)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def record(keys: list, texts: list[list[bytes]]):
            found = runs_of(texts, least)
            rows = np.concatenate(found)
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
            parts = [pa.array(rows[:, i].copy(), pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_pydict({
                "key": pa.array(keys, pa.int64()), "n_words": pa.array([len(w) for w in texts], pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["start", "length", "period"])),
                "collapsed": pa.array([collapsed(w, r) for w, r in zip(texts, found)], pa.binary()).cast(pa.string()),
            })

        keys, texts, held = [], [], 0
        for batch in batches:
            for k, body in zip(batch.column("key"), batch.column("text")):
                keys.append(k.as_py())
                texts.append((body.as_py() or "").encode().split())
                held += len(texts[-1]) + 1
                if held >= STREAM:
                    yield record(keys, texts)
                    keys, texts, held = [], [], 0
        if keys:
            yield record(keys, texts)

    schema = "key bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    narrow = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, schema).withColumnRenamed("key", key)
