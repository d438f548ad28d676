"""Validity, dead letters and hourly pattern summaries (capsules)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.constants import BUCKET, ENVIRONMENTS, EVENT_TYPES, MAX_SAMPLES, SEVERITIES
from tidegauge.functions.text import fingerprint, template_messages
from tidegauge.session import materialize

KEY = ["fingerprint_hash", "service_name", "time_bucket"]
REQUIRED = ["event_id", "service_name", "timestamp"]


def invalid_reason() -> Column:
    """Null for a valid row, else what is wrong with it."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED]
    reasons += [
        F.when(F.col("environment").isNotNull() & ~F.col("environment").isin(ENVIRONMENTS), "bad environment"),
        F.when(F.col("event_type").isNotNull() & ~F.col("event_type").isin(EVENT_TYPES), "bad event_type"),
        F.when(F.col("severity").isNotNull() & ~F.col("severity").isin(SEVERITIES), "bad severity"),
    ]
    return F.coalesce(*reasons)


def split_valid(events: DataFrame, ingest_time: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, dead letters ``original, reason, timestamp``)."""
    reason = invalid_reason()
    dead = events.filter(reason.isNotNull()).select(
        F.to_json(F.struct("*")).alias("original"),
        reason.alias("reason"),
        (F.current_timestamp() if ingest_time is None else ingest_time).alias("timestamp"),
    )
    return events.filter(reason.isNull()), dead


def hourly_templates(events: DataFrame, mode: str = "compat") -> DataFrame:
    """Valid events with their template and the hour they belong to."""
    valid, _ = split_valid(events)
    return template_messages(valid, mode=mode).withColumn("time_bucket", F.window("timestamp", BUCKET).start)


def hourly_fingerprints(events: DataFrame, mode: str = "compat") -> DataFrame:
    return hourly_templates(events, mode).withColumn("fingerprint_hash", fingerprint("template"))


def bottom_k(df: DataFrame, keys: list[str], id_col: str, k: int = MAX_SAMPLES) -> DataFrame:
    """The ``k`` rows per key with the smallest id hash: a uniform, repeatable sample.

    The rank limit is pushed below the shuffle, so each task sends at most ``k`` rows
    per key, however many rows a key owns.
    """
    hashed = df.withColumn("sample_hash", F.md5(F.col(id_col)))
    order = Window.partitionBy(*keys).orderBy("sample_hash", id_col)
    return hashed.withColumn("sample_rank", F.row_number().over(order)).filter(F.col("sample_rank") <= k)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def capsule_totals(templated: DataFrame, keys: list) -> DataFrame:
    """Count, time range and one counter per severity; batch and stream share it.

    The severities are a closed set and counted as columns, so this is one hash
    aggregate that combines a hot template before the shuffle.
    """
    return templated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("timestamp").alias("first_seen_at"),
        F.max("timestamp").alias("last_seen_at"),
        *[F.count_if(F.col("severity") == s).alias(f"_{s}") for s in SEVERITIES],
    )


def describe_totals(totals: DataFrame) -> DataFrame:
    """Fingerprint, severity map and primary severity from the totals.

    The primary severity is the most frequent one; among equals the higher rank.
    """
    entries = F.filter(
        F.array(*[F.struct(F.lit(s).alias("severity"), F.col(f"_{s}").alias("n")) for s in SEVERITIES]),
        lambda e: e["n"] > 0,
    )
    ranked = F.array(
        *[F.when(F.col(f"_{s}") > 0, F.struct(F.col(f"_{s}").alias("n"), F.lit(i).alias("r"), F.lit(s).alias("severity")))
          for i, s in enumerate(SEVERITIES)]
    )
    return totals.select(
        fingerprint("template").alias("fingerprint_hash"), "template", "service_name", "time_bucket",
        F.array_max(ranked)["severity"].alias("severity"), "count",
        F.map_from_entries(entries).alias("severity_distribution"), "first_seen_at", "last_seen_at",
    )


def capsule_counts(templated: DataFrame) -> DataFrame:
    """Capsules without samples. The template stands for its fingerprint while grouping,
    so the hash is computed once per capsule."""
    return describe_totals(capsule_totals(templated, ["template", "service_name", "time_bucket"]))


def pack_samples(picked: DataFrame, keys: list[str], with_attributes: bool = False) -> DataFrame:
    """The rows kept by ``bottom_k`` as arrays in rank order, at most ten entries."""
    more = ["attributes"] if with_attributes else []
    packed = picked.groupBy(*keys).agg(F.collect_list(F.struct("sample_rank", "event_id", *more)).alias("_s"))

    def in_order(field: str) -> Column:
        places = F.transform("_s", lambda s: s["sample_rank"])
        return F.transform(F.array_sort(places), lambda r: F.get(F.col("_s"), F.array_position(places, r) - 1)[field])

    columns = [*keys, in_order("event_id").alias("sample_event_ids")]
    if with_attributes:
        columns.append(in_order("attributes").alias("sample_array"))
    return packed.select(*columns)


def capsule_samples(templated: DataFrame, with_attributes: bool = False) -> DataFrame:
    """At most ten sample ids (and, if asked, their attribute maps) per capsule."""
    keys = ["template", "service_name", "time_bucket"]
    more = ["attributes"] if with_attributes else []
    return pack_samples(bottom_k(templated.select(*keys, "event_id", *more), keys, "event_id"), keys, with_attributes)


def build_capsules(
    events: DataFrame, mode: str = "compat", with_attributes: bool = False, stage: bool = False
) -> DataFrame:
    """Events to capsules, unique per (fingerprint, service, hour).

    Counts and samples read the templated rows once each. With ``stage`` these rows are
    written to the shared folder first, which trades one narrow write for running the
    pattern rules once; worth it when messages are long.
    """
    rows = hourly_templates(events, mode)
    if stage:
        narrow = ["template", "service_name", "time_bucket", "severity", "timestamp", "event_id"]
        rows = materialize(rows.select(*narrow, *(["attributes"] if with_attributes else [])), "templates")
    keys = ["template", "service_name", "time_bucket"]
    return capsule_counts(rows).join(capsule_samples(rows, with_attributes), keys)


def capsule_id() -> Column:
    """A stable id: the same key always names the same capsule."""
    return F.md5(F.concat_ws("|", "fingerprint_hash", "service_name", F.unix_seconds("time_bucket").cast("string")))


def latest_capsules(capsules: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` capsules of every fingerprint and service."""
    order = Window.partitionBy("fingerprint_hash", "service_name").orderBy(F.col("time_bucket").desc())
    return capsules.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= n)


def ready_for_embedding(capsules: DataFrame, flag: str = "redaction_checked") -> tuple[DataFrame, DataFrame]:
    """Only redacted text may be embedded: (admitted, refused)."""
    ok = F.coalesce(F.col(flag), F.lit(False))
    return capsules.filter(ok), capsules.filter(~ok)


def with_service_id(capsules: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Service ids by name: (found, misses). Works for a stream joined to a table."""
    joined = capsules.join(
        services.select(F.col("name").alias("service_name"), "service_id"), "service_name", "left"
    )
    return joined.filter("service_id is not null"), joined.filter("service_id is null").drop("service_id")
