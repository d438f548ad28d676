"""Exactly-once sinks for ``foreachBatch``.

A batch is written under its batch id with overwrite, or merged by key; a batch that is
replayed after a failure therefore leaves the same data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.constants import OVERSIZE_BYTES
from tidegauge.operators.capsules import split_valid
from tidegauge.session import discard, materialize, workspace
from tidegauge.sources.ingest import split_oversize
from tidegauge.sources.stores import upsert


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Appends each batch as its own folder; a replay overwrites that folder."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def upsert_writer(
    path: str, keys: list[str], time_column: str, newest: str | None = None, writer: str = "stream",
) -> Callable[[DataFrame, int], None]:
    """Merges each batch by key; a batch that the table has seen is left out. ``writer`` names the stream in the table."""
    def write(df: DataFrame, batch_id: int) -> None:
        upsert(path, df, keys, time_column, newest, writer, batch_id)

    return write


def split_writer(good_path: str, dead_path: str) -> Callable[[DataFrame, int], None]:
    """Valid rows to one table, dead letters to another, from one pass over the batch."""

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        tagged = workspace(spark, "batch")
        try:
            valid, dead = split_valid(materialize(df, "batch", tagged))
            valid.write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
            dead.write.mode("overwrite").parquet(f"{dead_path}/batch_id={batch_id}")
        finally:
            discard(spark, tagged)

    return write


def oversize_writer(rows_path: str, blobs_path: str, dead_path: str, limit: int = OVERSIZE_BYTES) -> Callable[[DataFrame, int], None]:
    """Rows, oversize messages (by day) and dead letters, from one staged batch."""

    def write(df: DataFrame, batch_id: int) -> None:
        staged = workspace(df.sparkSession, "batch")
        try:
            valid, dead = split_valid(materialize(df, "batch", staged))
            rows, blobs = split_oversize(valid, limit)
            here = f"batch_id={batch_id}"
            blobs.withColumn("day", F.split("key", "/")[1]).write.mode("overwrite").partitionBy("day").parquet(f"{blobs_path}/{here}")
            rows.write.mode("overwrite").parquet(f"{rows_path}/{here}")
            dead.write.mode("overwrite").parquet(f"{dead_path}/{here}")
        finally:
            discard(df.sparkSession, staged)

    return write


def with_fallback(
    primary: Callable[[DataFrame, int], None], fallback: Callable[[DataFrame, int], None]
) -> Callable[[DataFrame, int], None]:
    """Sends a batch to the fallback when the primary write fails, so the stream goes on.

    The batch is stored first, so whatever made it (a model, say) runs once.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        staged = workspace(df.sparkSession, "batch")
        try:
            rows = materialize(df, "batch", staged)
            try:
                primary(rows, batch_id)
            except Exception as error:  # any failure of the outer store
                fallback(rows.withColumn("error", F.lit(str(error))), batch_id)
        finally:
            discard(df.sparkSession, staged)

    return write
