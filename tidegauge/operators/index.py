"""A fitted vector index: cells around learned centres, probed nearest first, re-ranked exactly.

Centres are learned on a bounded sample by rounds of assignment and averaging. Every
vector is stored under the cell of its nearest centre, the partition column of the
table, so a search opens only the folders that some query probes. How many cells a query
probes is measured when the index is fitted: for a bounded number of stored vectors the
exact neighbours are found, and the number is raised until the wanted share of them lies
in the probed cells. What lies there is scored exactly, so found scores are true ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.vectors import batch_search, matrix

# centres come to every task: 4,096 of 1,536 doubles are 50 MB
MOST_CELLS = 4096
# the sample that centres are learned on, in one task: 20,000 vectors of 1,536 doubles are 245 MB
SAMPLE, ROUNDS = 20_000, 4
# stored vectors whose exact neighbours set the number of probes, and the share of them to be found
TRIALS, TARGET = 64, 0.95
TILE = 2048


class Index(NamedTuple):
    path: str
    centres: np.ndarray
    probes: int
    schema: T.StructType  # of the stored vectors, which may be none

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/vectors")


def _by_hash(vectors: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` vectors of smallest hash: a uniform sample that every run repeats."""
    return vectors.orderBy(F.md5("capsule_id"), "capsule_id", "vector").limit(limit)


def nearest_cells(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cell of each vector; scores are rounded so that ties go to the lower cell on every machine."""
    found = [np.round(vectors[at:at + TILE] @ centres.T, 9).argmax(axis=1) for at in range(0, len(vectors), TILE)]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def learned(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Unit centres; they start as the first vectors of the sample, a cell without members stays."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        cell = nearest_cells(sample, centres)
        used, counts = np.unique(cell, return_counts=True)
        sums = np.add.reduceat(sample[np.argsort(cell, kind="stable")], np.concatenate(([0], np.cumsum(counts)[:-1])))
        means = sums / counts[:, None]
        norm = np.linalg.norm(means, axis=1, keepdims=True)
        centres[used] = np.round(means / np.where(norm > 0, norm, 1), 9)
    return centres


def _centres(vectors: DataFrame, cells: int, sample: int, rounds: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [matrix(b.column("vector")) for b in batches if b.num_rows]
        if parts:
            found = learned(np.concatenate(parts), cells, rounds)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(range(len(found)), pa.int32()), "centre": pa.array(found.tolist(), pa.list_(pa.float64()))})

    # a top-k leaves one partition in order; the rows keep it
    return _by_hash(vectors, sample).select("vector").mapInArrow(run, "cell int, centre array<double>")


def in_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors`` with the column ``cell``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = nearest_cells(matrix(batch.column("vector")), centres) if batch.num_rows else np.empty(0, np.int64)
            yield batch.append_column("cell", pa.array(cell, pa.int32()))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{names}, cell int")


def probed(queries: DataFrame, centres: np.ndarray, probes: int | None = None) -> DataFrame:
    """``queries`` with ``cells``, nearest first: all or the first ``probes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.round(matrix(batch.column("vector")) @ centres.T, 9) if batch.num_rows else np.empty((0, len(centres)))
            order = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
            yield batch.append_column("cells", pa.array(order.tolist(), pa.list_(pa.int32())))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{names}, cells array<int>")


def fit_index(
    vectors: DataFrame, path: str, k: int = 10, cells: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS,
    trials: int = TRIALS, target: float = TARGET,
) -> Index:
    """Stores ``vectors`` (``capsule_id``, ``vector`` and any other columns) under ``path`` by cell; without a given number, cells are the root of the rows."""
    spark = vectors.sparkSession
    vectors = vectors.where("vector IS NOT NULL")
    cells = max(1, min(MOST_CELLS, cells or int(np.ceil(np.sqrt(vectors.count())))))
    _centres(vectors, cells, sample, rounds).write.mode("overwrite").parquet(f"{path}/centres")
    centres = _read_centres(spark, path)
    placed = in_cells(vectors, centres)
    placed.hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    ranks = _cell_ranks(spark, Index(path, centres, 0, placed.schema), k, trials)
    wanted = F.element_at(F.array_sort(F.collect_list("rank")), F.ceil(F.count("rank") * target).cast("int"))  # trials x k numbers
    settings = ranks.agg(F.when(F.count("rank") > 0, wanted).otherwise(1).alias("probes"), F.lit(placed.schema.json()).alias("schema"))
    settings.write.mode("overwrite").parquet(f"{path}/settings")
    return open_index(spark, path)


def _read_centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MOST_CELLS
    return np.array([r.centre for r in rows], np.float64) if rows else np.empty((0, 0))


def _cell_ranks(spark: SparkSession, index: Index, k: int, trials: int) -> DataFrame:
    """For each exact neighbour of the trial vectors the place of its cell in the order that the trial probes."""
    stored = index.vectors(spark)
    asked = _by_hash(stored.select("capsule_id", "vector"), trials).withColumnRenamed("capsule_id", "query_id")
    truth = batch_search(stored, asked, k, skip_self=True).select("query_id", "capsule_id")
    met = truth.join(stored.select("capsule_id", "cell"), "capsule_id").join(probed(asked, index.centres).select("query_id", "cells"), "query_id")
    return met.select(F.array_position("cells", F.col("cell")).cast("int").alias("rank"))


def open_index(spark: SparkSession, path: str) -> Index:
    settings = spark.read.parquet(f"{path}/settings").first()
    return Index(path, _read_centres(spark, path), settings["probes"], T.StructType.fromJson(json.loads(settings["schema"])))


def search_index(spark: SparkSession, index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, where: Column | None = None) -> DataFrame:
    """Top ``k`` among the vectors of the cells that each query probes: ``query_id, capsule_id, score, position``.

    Only folders of cells that some query probes are opened; ``where`` filters vectors
    before they are scored.
    """
    asked = probed(queries.where("vector IS NOT NULL"), index.centres, probes or index.probes)
    stored = index.vectors(spark)
    wanted = sorted(r.cell for r in asked.select(F.explode("cells").alias("cell")).distinct().collect())  # at most MOST_CELLS numbers
    stored = stored.where(F.col("cell").isin(wanted)) if wanted else stored.where("false")
    stored = stored if where is None else stored.where(where)
    return batch_search(stored, asked.withColumnRenamed("cells", "cell"), k, within="cell")


def pairs_scored(spark: SparkSession, index: Index, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """``query_id``, ``scored`` and ``stored``: vectors that a query is compared with, and all."""
    sizes = index.vectors(spark).groupBy("cell").count()
    asked = probed(queries, index.centres, probes or index.probes).select("query_id", F.explode("cells").alias("cell"))
    total = sizes.agg(F.sum("count").alias("stored"))
    return asked.join(sizes, "cell").groupBy("query_id").agg(F.sum("count").alias("scored")).join(F.broadcast(total), F.lit(True))
