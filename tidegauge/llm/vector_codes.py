"""Vector code compression: product codes whose distances are gathers from per-dimension value dictionaries.

Vectors become integers, floor(scale * x), and are stored in blocks of bounded size: per
dimension a dictionary of the block's distinct integers and one short code a vector. A
pass tabulates the squared differences of every dictionary value to all entries of a
codebook once; the distance of a part to all entries is then, per dimension, a gather of
table rows by code and an addition.

Rounds of assignment and averaging learn one codebook per part. A task sends one row per
part and entry that it met (count and sums), whatever the number of its vectors; only
codebooks, entries x dimensions numbers, come to the driver.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped. The length of the vectors is that of the smallest kept key; kept vectors of
another length are dropped too. A length that the parts do not divide gives the first
parts one component more; empty vectors have code 0 and error 0. Fewer vectors than
entries make smaller codebooks. Repeated keys are all kept, equal keys are ordered by
their integers, null keys are last. Integers beyond 2**62 count as that bound, errors
beyond 2**63 - 1 as that; in between all arithmetic is exact. Null labels are one label.
Extra columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import materialize

#: Vectors of a block; its dictionaries are no larger.
BLOCK = 4096
#: Vectors whose distances to all entries are held at once.
TILE = 1024
MOST = 1 << 62
LARGEST = (1 << 63) - 1


class Codes(NamedTuple):
    """key, label, code (hexadecimal, two digits a part), error; and the codebooks, one array (entry, component) per part."""

    rows: DataFrame
    books: list[np.ndarray]


def finite(vector) -> F.Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers within the bound."""
    scaled = np.floor(np.asarray(vectors, np.float64) * scale)
    return np.where(scaled >= MOST, MOST, np.where(scaled <= -MOST, -MOST, scaled)).astype(np.int64)


def cuts(dims: int, parts: int) -> list[int]:
    """First dimension of every part, and the end."""
    size, more = divmod(dims, parts)
    return [i * size + min(i, more) for i in range(parts + 1)]


def blocks(vectors: DataFrame, key: str, vector: str, label: str, dims: int, scale: int, block: int = BLOCK) -> DataFrame:
    """One row per block: keys, labels, and per dimension its dictionary (``values``) and ``codes``."""
    label_type = vectors.schema[label].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                numbers = whole(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims), scale)
                values, codes = [], []
                for column in numbers.T:
                    found, code = np.unique(column, return_inverse=True)
                    values.append(found.tolist())
                    codes.append(code.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.column("key").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("label").to_pylist()], pa.list_(part.column("label").type)),
                    pa.array([values], pa.list_(pa.list_(pa.int64()))), pa.array([codes], pa.list_(pa.binary())),
                ], ["keys", "labels", "values", "codes"])

    rows = vectors.where(finite(F.col(vector)) & (F.size(vector) == dims))
    rows = rows.select(F.col(key).cast("bigint").alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    return rows.mapInArrow(run, f"keys array<bigint>, labels array<{label_type}>, values array<array<bigint>>, codes array<binary>")


def fitting(values: list[np.ndarray], entries: np.ndarray) -> type:
    """The narrowest type that holds every distance of this part."""
    most = max([1, int(abs(entries).max()) if entries.size else 1, *(max(abs(int(v[0])), abs(int(v[-1]))) for v in values if len(v))])
    bound = (2 * most) ** 2 * max(1, len(values))
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def nearest(values: list[np.ndarray], codes: list[np.ndarray], entries: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower one) and the squared distance, for the ``n`` parts of one block."""
    kind = fitting(values, entries)
    tables = [(v.astype(kind)[:, None] - column.astype(kind)[None, :]) ** 2 for v, column in zip(values, entries.T)]
    index, least = np.zeros(n, np.int64), np.zeros(n, object if kind is object else np.int64)
    for at in range(0, n, TILE) if tables else ():
        total = tables[0][codes[0][at:at + TILE]]
        for table, code in zip(tables[1:], codes[1:]):
            total += table[code[at:at + TILE]]
        index[at:at + TILE] = total.argmin(axis=1)
        least[at:at + TILE] = total[np.arange(len(total)), index[at:at + TILE]]
    return index, least


def _opened(batches: Iterator) -> Iterator[tuple[list, list, list[np.ndarray], list[np.ndarray]]]:
    for batch in batches:
        for keys, labels, values, codes in zip(*(batch.column(c) for c in ("keys", "labels", "values", "codes"))):
            yield keys.as_py(), labels.as_py(), [np.array(v, np.int64) for v in values.as_py()], [np.frombuffer(c, "<u2") for c in codes.as_py()]


def _moved(stored: DataFrame, books: list[np.ndarray], ends: list[int]) -> list[np.ndarray]:
    """Codebooks after one round: the floored means of what is nearest to each entry."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        for keys, _, values, codes in _opened(batches):
            for p, (a, b) in enumerate(zip(ends, ends[1:])):
                index, _ = nearest(values[a:b], codes[a:b], books[p], len(keys))
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                counts[p] += np.bincount(index, minlength=len(books[p]))
                for d in range(a, b):
                    kind = object if int(abs(values[d]).max()) >= 1 << 48 else np.int64
                    sums[p][used, d - a] += np.add.reduceat(values[d].astype(kind)[codes[d][order]], first).astype(object)
        rows = [(p, e, int(counts[p][e]), [str(x) for x in sums[p][e]]) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist()]
        if rows:
            part, entry, n, total = zip(*rows)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()),
                "n": pa.array(n, pa.int64()), "sums": pa.array(total, pa.list_(pa.string())),
            })

    met = stored.mapInArrow(run, "part int, entry int, n bigint, sums array<string>")
    spread = met.select("part", "entry", "n", F.posexplode("sums").alias("d", "sum"))
    totals = spread.groupBy("part", "entry", "d").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    out = [b.copy() for b in books]
    for r in totals.collect():  # entries x dimensions rows
        out[r.part][r.entry, r.d] = int(r["sum"]) // r.n
    return out


def compressed(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
) -> Codes:
    """Learns the codebooks from the ``entries`` smallest keys on, and codes every vector with them."""
    if not 0 < entries <= 256:
        raise ValueError("a code of two hexadecimal digits names at most 256 entries")
    kept = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label")).where(finite(F.col("vector")))
    first = kept.orderBy(F.col("key").asc_nulls_last(), "vector").limit(1).collect()
    dims = len(first[0].vector) if first else 0
    ends = cuts(dims, parts)
    numbers = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    start = kept.where(F.size("vector") == dims).orderBy(F.col("key").asc_nulls_last(), numbers, "vector").limit(entries).select("vector").collect()
    begun = whole(np.array([r.vector for r in start], np.float64).reshape(len(start), dims), scale)
    books = [begun[:, a:b] for a, b in zip(ends, ends[1:])]
    stored = materialize(blocks(kept, "key", "vector", "label", dims, scale), "vector-blocks")
    for _ in range(rounds if start else 0):
        books = _moved(stored, books, ends)
    kind = vectors.schema[label].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kinds = batch.column("labels").type.value_type
            for keys, labels, values, codes in _opened(iter([batch])):
                found = [nearest(values[a:b], codes[a:b], book, len(keys)) for book, a, b in zip(books, ends, ends[1:])]
                code = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
                error = sum(least.astype(object) for _, least in found)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(keys, pa.int64()), "label": pa.array(labels, kinds), "code": pa.array([c.tobytes().hex() for c in code]),
                    "error": pa.array([min(LARGEST, int(e)) for e in error], pa.int64()),
                })

    return Codes(stored.mapInArrow(run, f"key bigint, label {kind}, code string, error bigint"), books)


def label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the errors summed over equal labels."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("bigint")
    sums = rows.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
