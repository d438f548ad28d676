"""Tables on shared storage: capsules, samples, vectors; upkeep and statistics.

Capsules, objectives, raw rows and vectors are versioned tables by date (vectors by
environment); sample files and summaries are plain partitions that writers replace
whole, so a repeated write leaves the same table.
"""

from __future__ import annotations

from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidegauge.constants import (
    CAPSULE_COMPACT_DAYS, CAPSULE_RETENTION_DAYS, MAX_SAMPLES, OBJECTIVE_COMPACT_DAYS, OBJECTIVE_RETENTION_DAYS, RAW_RETENTION_DAYS,
)
from tidegauge.schemas import STRING_MAP
from tidegauge.sources.versions import VersionedTable


def read_or_none(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    # the rebalance splits a huge day over many tasks and keeps a small one in one file
    df.hint("rebalance", F.col(partition)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(partition).parquet(path)


def upsert(
    path: str, changes: DataFrame, keys: list[str], time_column: str, newest: str | None = None,
    writer: str | None = None, batch: int | None = None,
) -> None:
    """Insert or replace by key; touches only the days that occur in ``changes``.

    Within one change set the row with the largest ``newest`` value wins. With the name
    of a ``writer`` and a number that grows, a repeated ``batch`` does nothing.
    """
    table = VersionedTable(changes.sparkSession, path)
    table.upsert(changes.withColumn("day", F.to_date(time_column)), keys, newest, writer, batch)


def read_table(spark: SparkSession, path: str, partition: str = "day") -> DataFrame | None:
    """The newest version of a stored table; None before the first write."""
    return VersionedTable(spark, path, partition).read()


class Policy(NamedTuple):
    """Days after which partitions are dropped, and after which they are rewritten by ``segment``, newest ``order`` first.

    A partition is a ``day`` or, where a day has few rows, a ``month``; it goes when all of it is too old.
    """

    retention: int
    compaction: int | None = None
    segment: str | None = None
    order: str | None = None
    partition: str = "day"


POLICIES = {
    "capsules": Policy(CAPSULE_RETENTION_DAYS, CAPSULE_COMPACT_DAYS, "service_name", "time_bucket"),
    "objectives": Policy(OBJECTIVE_RETENTION_DAYS, OBJECTIVE_COMPACT_DAYS, "sli_id", "created_at", "month"),
    "raw": Policy(RAW_RETENTION_DAYS),
}


def upkeep(spark: SparkSession, path: str, kind: str, as_of) -> dict[str, list[str]]:
    """Applies the policy of a kind of table as of a day; returns the days (or months) dropped and rewritten."""
    policy = POLICIES[kind]
    dropped = drop_expired(path, spark, as_of, policy.retention, policy.partition)
    if policy.compaction is None:
        return {"dropped": dropped, "rewritten": []}
    return {"dropped": dropped, "rewritten": compact(path, spark, as_of, policy.compaction, policy.segment, policy.order, policy.partition)}


def _oldest(as_of, days: int, partition: str) -> str:
    """The first partition that is not wholly older than so many days."""
    return str(date.fromisoformat(str(as_of)[:10]) - timedelta(days=days))[:7 if partition == "month" else 10]


def drop_expired(path: str, spark: SparkSession, as_of, days: int, partition: str = "day") -> list[str]:
    """Drops what is older than the retention time from the table; returns it. No data file is opened."""
    return VersionedTable(spark, path, partition).expire(_oldest(as_of, days, partition))


def unexpired(df: DataFrame, time_column: str, as_of, days: int) -> DataFrame:
    """The rows a retention run keeps."""
    return df.filter(F.to_date(time_column) >= F.to_date(F.lit(as_of)) - F.lit(days))


def compact(
    path: str, spark: SparkSession, as_of, older_than_days: int, segment: str, order: str, partition: str = "day", salts: int = 8,
) -> list[str]:
    """Rewrites old partitions in place, segmented by ``segment``, newest first, with strong compression; returns them."""
    return VersionedTable(spark, path, partition).compact(segment, order, _oldest(as_of, older_than_days, partition), salts)


def table_stats(df: DataFrame, name: str) -> DataFrame:
    """Files, rows and bytes of a stored table, from file metadata and counts."""
    files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), F.max("b").alias("b")
    )
    return files.agg(
        F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("num_chunks"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("b"), F.lit(0)).alias("total_size"),
    )


def collection_stats(vectors: DataFrame, name: str = "capsules") -> DataFrame:
    return vectors.agg(F.lit(name).alias("collection_name"), F.count(F.lit(1)).alias("num_entities"))


# --- sample files --------------------------------------------------------------------


def write_samples(capsules: DataFrame, path: str) -> None:
    """Samples as gzipped JSON lines in folders by day and first fingerprint digit.

    One file per capsule would mean billions of files; a folder per day and digit holds
    many capsules and is still pruned to by a key. A capsule with more than ten samples
    fails the write.
    """
    too_many = F.size("sample_array") > MAX_SAMPLES
    checked = F.when(
        too_many, F.raise_error(F.concat(F.lit("too many samples: "), F.size("sample_array").cast("string"))).cast(
            capsules.schema["sample_array"].dataType)
    ).otherwise(F.col("sample_array"))
    rows = capsules.select(
        F.to_date("time_bucket").alias("day"), F.substring("fingerprint_hash", 1, 1).alias("prefix"),
        "fingerprint_hash", "service_name", F.unix_seconds("time_bucket").alias("bucket"),
        F.explode(checked).alias("sample"),
    )
    rows.hint("rebalance", F.col("day"), F.col("prefix")).write.mode(
        "overwrite"
    ).option("compression", "gzip").partitionBy("day", "prefix").json(path)


def read_samples(spark: SparkSession, path: str, fingerprint: str | None = None, day=None) -> DataFrame:
    """Samples by key or by day; both are partition filters."""
    schema = "fingerprint_hash string, service_name string, bucket bigint, sample map<string,string>, day date, prefix string"
    df = spark.read.schema(schema).json(path)
    if fingerprint is not None:
        df = df.filter((F.col("prefix") == fingerprint[:1]) & (F.col("fingerprint_hash") == fingerprint))
    if day is not None:
        df = df.filter(F.col("day") == F.lit(day).cast("date"))
    return df


def expand_sample_ids(ids: Column, bucket: Column) -> Column:
    """Sample ids as {event_id, timestamp} maps, stamped with the bucket time."""
    return F.transform(
        ids, lambda i: F.create_map(F.lit("event_id"), i, F.lit("timestamp"), F.unix_millis(bucket).cast("string"))
    ).cast(f"array<{STRING_MAP.simpleString()}>")


# --- vectors -------------------------------------------------------------------------


def insert_vectors(vectors: DataFrame, path: str, writer: str | None = None, batch: int | None = None) -> None:
    """Adds vectors; a batch that is inserted again does nothing."""
    VersionedTable(vectors.sparkSession, path, "environment").append(vectors, writer, batch)


def delete_vectors(spark: SparkSession, path: str, ids: DataFrame, writer: str | None = None, batch: int | None = None) -> None:
    """Marks the ids (``capsule_id``, and ``environment`` if given) as deleted; ``compact_vectors`` folds the marks in."""
    keys = [c for c in ("environment", "capsule_id") if c in ids.columns]
    VersionedTable(spark, path, "environment").delete(ids.select(*keys), writer, batch)


def read_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    return read_table(spark, path, "environment")


def compact_vectors(spark: SparkSession, path: str, segment: str = "service_name", order: str = "time_bucket") -> list[str]:
    return VersionedTable(spark, path, "environment").compact(segment, order)


# --- incremental summary ---------------------------------------------------------------


def refresh_summary(path: str, objectives: DataFrame, now, start_days: int = 3, end_hours: int = 1) -> None:
    """Recomputes the months the refresh window touches and replaces just these partitions.

    The source is filtered to whole affected months, so older partitions stay as they
    are. A summary holds few rows per day, hence the month as the partition.
    """
    from tidegauge.operators.metrics import daily_objective_summary

    end = F.lit(now).cast("timestamp")
    first = F.date_trunc("month", end - F.make_dt_interval(F.lit(start_days)))
    last = end - F.make_dt_interval(F.lit(0), F.lit(end_hours))
    affected = objectives.filter((F.col("created_at") >= first) & (F.col("created_at") < last))
    summary = daily_objective_summary(affected).withColumn("month", F.date_format("bucket", "yyyy-MM"))
    _replace_partitions(summary, path, "month")
