"""Embedding and top-K similarity search.

The corpus is never moved: queries are stored once in blocks, every task that scans the
corpus reads them from there and keeps its best K per query, and only those survivors
are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.constants import EMBED_BATCH
from tidegauge.session import materialize

# queries and corpus rows per block: 2,048 and 8,192 vectors of 1,536 doubles are 25 and 100 MB in a task
QUERY_BLOCK, CORPUS_BLOCK = 2048, 8192
# numbers of query vectors that a task keeps in memory; candidates it holds before it hands them on
HELD_NUMBERS, HELD_HITS = 8 << 20, 2 << 20
MIN_SIMILARITY = 0.5
DIMENSION = 384
SKETCH_BITS = 8

HITS = "query_id string, capsule_id string, score double"


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def collection_filter(
    vectors: DataFrame, service: str | None = None, environment: str | None = None,
    as_of=None, time_range_days: int | None = None,
) -> DataFrame:
    """Metadata filters, applied before any scoring so they reach the scan."""
    if service is not None:
        vectors = vectors.filter(F.col("service_name") == service)
    if environment is not None:
        vectors = vectors.filter(F.col("environment") == environment)
    if time_range_days is not None:
        end = F.lit(as_of).cast("timestamp")
        vectors = vectors.filter(F.col("time_bucket").between(end - F.make_dt_interval(F.lit(time_range_days)), end))
    return vectors


def search(vectors: DataFrame, query: list[float], k: int = 10, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Top ``k`` for one query vector; the similarity floor applies after the top ``k``."""
    q = F.array(*[F.lit(float(x)) for x in query])
    top = (
        vectors.withColumn("score", F.round(inner_product(F.col("vector"), q), 9))
        .orderBy(F.col("score").desc(), "capsule_id")
        .limit(k)
    )
    return above_floor(top, min_similarity)


def above_floor(hits: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    return hits.filter(F.col("score") >= min_similarity)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


class QueryBlocks:
    """Stored queries, a block at a time; read again for every corpus block unless they are few."""

    def __init__(self, files: list[str], size: int):
        self.files, self.size, self.held = sorted(files), size, None

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            yield from self.held
            return
        held, numbers = [], 0
        for path in self.files:
            system, local = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
            with system.open_input_file(local) as source:
                for block in pq.ParquetFile(source).iter_batches(self.size):
                    numbers += len(block.column("vector").flatten())
                    held.append(block)
                    if numbers > HELD_NUMBERS:
                        held.clear()
                    yield block
        if numbers <= HELD_NUMBERS:
            self.held = held


def _met(rows: pa.RecordBatch, block: pa.RecordBatch, k: int, timed: bool, skip_self: bool) -> Iterator[pd.DataFrame]:
    """Best ``k`` rows of one corpus block for every query of one query block, for each key they share."""
    keys, lists = rows.column("key").to_numpy(zero_copy_only=False), block.column("keys")
    of = np.repeat(np.arange(block.num_rows), np.diff(lists.offsets.to_numpy()))
    offered = lists.flatten().to_numpy(zero_copy_only=False)
    names, ids = rows.column("capsule_id").to_numpy(zero_copy_only=False), block.column("query_id").to_numpy(zero_copy_only=False)
    vectors, wanted = None, None
    for key in np.intersect1d(keys.astype(str), offered.astype(str)):
        if vectors is None:
            vectors, wanted = matrix(rows.column("vector")), matrix(block.column("vector"))
        r, q = np.flatnonzero(keys == key), np.unique(of[offered == key])
        # rounding makes equal vectors tie exactly, whatever block they sit in
        scores = np.round(vectors[r] @ wanted[q].T, 9)
        if timed:
            t, start, end = (b.column(c).to_numpy()[i] for b, c, i in ((rows, "_t", r), (block, "_f", q), (block, "_u", q)))
            scores[(t[:, None] < start[None, :]) | (t[:, None] > end[None, :])] = -np.inf
        if skip_self:
            scores[names[r][:, None] == ids[q][None, :]] = -np.inf
        floor = np.full(len(q), -np.inf)
        if len(r) > k:
            floor = np.partition(scores, len(r) - k, axis=0)[len(r) - k]
        # rows that tie with the edge stay for the id rule
        row, column = np.nonzero((scores >= floor[None, :]) & (scores > -np.inf))
        if len(row):
            yield best(pd.DataFrame({"query_id": ids[q][column], "capsule_id": names[r][row], "score": scores[row, column]}), k)


def best(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    return hits.sort_values(["query_id", "score", "capsule_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)


def batch_search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, same: tuple[str, ...] = (),
    timed: bool = False, skip_self: bool = False, block_size: int = QUERY_BLOCK, within: str | None = None,
) -> DataFrame:
    """Exact top ``k`` of every query: ``query_id, capsule_id, score, position``.

    ``same`` names columns that must be equal in query and vector (null equals nothing);
    ``within`` names a column of the vectors and an array column of the queries that must
    hold its value. ``timed`` limits a query to vectors whose ``time_bucket`` lies in its
    ``time_from``..``time_to``. Queries are stored once, ordered by what they look for. A
    task that scans a part of the corpus reads them in blocks of ``block_size``, skips
    blocks that share no key with its rows, and keeps the best ``k`` per query; these are
    cut again before the only shuffle, which therefore carries at most ``k`` rows per
    query and task, whatever the size of the corpus. Neither side passes through the
    driver. The scratch table is read with pyarrow, whose filesystem must know its scheme.
    """
    def text(c: str) -> Column:
        return F.col(c).cast("string")

    if within:
        key, keys = text(within), F.transform(within, lambda x: x.cast("string"))
    else:
        key = F.concat_ws("\x1f", *map(text, same)) if same else F.lit("")
        keys = F.array(key)
    some = " AND ".join(f"{c} IS NOT NULL" for c in ["vector", *same, *([within] if within else [])])
    wanted = queries.where(some).select(
        F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), keys.alias("keys"),
        *([F.unix_seconds("time_from").alias("_f"), F.unix_seconds("time_to").alias("_u")] if timed else []),
    )
    blocks = QueryBlocks(materialize(wanted.repartitionByRange(F.col("keys")[0], "query_id"), "queries").inputFiles(), block_size)
    corpus = vectors.where(some).select(
        F.col("capsule_id").cast("string").alias("capsule_id"), "vector", key.alias("key"),
        *([F.unix_seconds("time_bucket").alias("_t")] if timed else []),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, least = [], 0, HELD_HITS

        def hand_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(held[0], preserve_index=False)

        for batch in batches:
            for at in range(0, batch.num_rows, CORPUS_BLOCK):
                for block in blocks:
                    for hits in _met(batch.slice(at, CORPUS_BLOCK), block, k, timed, skip_self):
                        held.append(hits)
                        count += len(hits)
                    if count > least:
                        held = [best(pd.concat(held), k)]
                        count = len(held[0])
                        if count > HELD_HITS // 2:  # too many queries to hold: the shuffle cuts again
                            yield hand_on()
                            held, count = [], 0
        if held:
            held = [best(pd.concat(held), k)]
            yield hand_on()

    found = corpus.mapInArrow(run, HITS)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "capsule_id")
    return found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def related_capsules(vectors: DataFrame, capsule_ids: DataFrame, k: int = 5) -> DataFrame:
    """The nearest other capsules of the given capsules."""
    chosen = vectors.join(capsule_ids.select("capsule_id").distinct(), "capsule_id", "left_semi")
    return batch_search(vectors, chosen.select(F.col("capsule_id").alias("query_id"), "vector"), k, skip_self=True)


def search_texts(corpus: DataFrame, texts: DataFrame, id_col: str, text: str, k: int = 20) -> DataFrame:
    """The ``k`` nearest texts of the corpus for every row of ``texts`` (``query_id`` and the text column)."""
    vectors = embed_terms(corpus, id_col, text).withColumnRenamed(id_col, "capsule_id")
    wanted = embed_terms(texts, "query_id", text, fit=corpus.withColumnRenamed(id_col, "query_id"))
    return batch_search(vectors, wanted, k)


# --- approximate search ----------------------------------------------------------------


def sketch(vector: Column, bits: int = SKETCH_BITS) -> Column:
    """A sign sketch: bit j compares two strided quarter sums of the vector.

    Vectors at a small angle share most bits. Written as a column expression, so it can
    be stored as a partition column and pruned.
    """
    def quarter(j: int, q: int) -> Column:
        return F.aggregate(
            F.filter(vector, lambda x, i: (i % (4 * bits)) == (j + q * bits)),
            F.lit(0.0), lambda a, x: a + x.cast("double"),
        )

    total = F.lit(0)
    for j in range(bits):
        side = (quarter(j, 0) + quarter(j, 1)) > (quarter(j, 2) + quarter(j, 3))
        total = total + F.when(side, 1 << j).otherwise(0)
    return total.cast("int")


def approximate_search(vectors: DataFrame, queries: DataFrame, k: int = 10, radius: int = 2) -> DataFrame:
    """Top ``k`` among vectors whose sketch differs in at most ``radius`` bits.

    ``vectors`` may carry a stored ``sketch`` column; written as a partition column it
    prunes whole folders. Queries meet vectors by the sketches they probe, before any product;
    survivors are scored exactly. A larger radius raises recall;
    ``radius = SKETCH_BITS`` is the exact answer.
    """
    if "sketch" not in vectors.columns:
        vectors = vectors.withColumn("sketch", sketch(F.col("vector")))
    return batch_search(vectors, probes(queries, radius), k, within="sketch")


def probes(queries: DataFrame, radius: int) -> DataFrame:
    """``sketch``: all sketches that differ from a query's own in at most ``radius`` bits."""
    near = F.array(*[F.lit(flip) for flip in range(1 << SKETCH_BITS) if flip.bit_count() <= radius])
    own = queries.withColumn("_own", sketch(F.col("vector")))
    return own.withColumn("sketch", F.transform(near, lambda flip: F.col("_own").bitwiseXOR(flip))).drop("_own")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the exact answers that the approximate search found, per query."""
    hit = found.select("query_id", "capsule_id", F.lit(1).alias("hit"))
    return truth.join(hit, ["query_id", "capsule_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("expected"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found")
    ).withColumn("recall", F.col("found") / F.col("expected"))


# --- embedding -----------------------------------------------------------------------


class Embedder(Protocol):
    """What a pluggable model must offer; batches are lists of texts."""

    name: str
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


def embed_with(df: DataFrame, text: str, embedder: Embedder, batch: int = EMBED_BATCH) -> DataFrame:
    """Adds ``vector`` (L2-normalised) with a model that runs inside the tasks."""
    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                m = np.asarray(embedder.embed(part[text].tolist()), dtype=np.float32)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(norm > 0, norm, 1)
                yield part.assign(vector=list(m))

    return df.mapInPandas(run, schema)


def _terms(df: DataFrame, id_col: str, text: str, dimension: int) -> DataFrame:
    word = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z_]+"), F.lit(0)))
    slot = F.pmod(F.conv(F.substring(F.md5(F.col("word")), 1, 6), 16, 10).cast("bigint"), F.lit(dimension))
    return (
        df.select(id_col, word.alias("word"))
        .select(id_col, slot.cast("int").alias("slot"))
        .groupBy(id_col, "slot")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def embed_terms(df: DataFrame, id_col: str, text: str, fit: DataFrame | None = None, dimension: int = DIMENSION) -> DataFrame:
    """Built-in embedding: hashed term frequency x inverse document frequency, unit length.

    ``fit`` is the corpus whose document frequencies are used (default: ``df``). There
    are at most ``dimension`` slot rows, so the frequency table is always small.
    Texts without any term are left out.
    """
    tf = _terms(df, id_col, text, dimension)
    base = tf if fit is None else _terms(fit, id_col, text, dimension)
    size = (df if fit is None else fit).agg(F.count(F.lit(1)).alias("n_docs"))
    idf = base.groupBy("slot").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(size), F.lit(True)).select(
        "slot", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf")
    )
    unseen = F.log(F.col("n_docs") + 1) + 1
    weighted = (
        tf.join(F.broadcast(idf), "slot", "left")
        .join(F.broadcast(size), F.lit(True))
        .select(id_col, "slot", (F.col("tf") * F.coalesce("idf", unseen)).alias("w"))
    )
    # same partitioning as the grouping below, hence no second shuffle
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    # at most `dimension` entries per text; the filter also keeps the optimizer from
    # rebuilding the map for every slot
    packed = (
        weighted.withColumn("x", F.col("w") / norm)
        .groupBy(id_col)
        .agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"))
        .filter(F.size("m") > 0)
    )
    slots = F.sequence(F.lit(0), F.lit(dimension - 1))
    return packed.select(id_col, F.transform(slots, lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vector"))
