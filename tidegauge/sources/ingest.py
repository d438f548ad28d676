"""Collector mappings: metric samples, trace exports and log batches to telemetry rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.constants import OVERSIZE_BYTES
from tidegauge.schemas import TELEMETRY

_COLUMNS = [f.name for f in TELEMETRY.fields]


def _shape(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TELEMETRY.fields]
    )


def stable_event_id(*parts: Column) -> Column:
    """A repeatable id in place of a clock-based one, so a retried task emits the same row."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def metric_samples(samples: DataFrame) -> DataFrame:
    """(metric_name, labels, timestamp, value) to telemetry."""
    name, job = F.col("metric_name"), F.col("labels")["job"]
    text = F.format_string("%.6f", F.col("value"))
    return _shape(samples, {
        "event_id": stable_event_id(name, F.to_json("labels"), F.unix_micros("timestamp")),
        "service_name": F.coalesce(job, F.lit("")),
        "environment": F.coalesce(F.col("labels")["environment"], F.lit("prod")),
        "event_type": F.lit("metric"),
        "timestamp": F.col("timestamp"),
        "severity": F.lit("INFO"),
        "message": F.concat(name, F.lit("="), text),
        "attributes": F.create_map(F.lit("metric_name"), name, F.lit("metric_value"), text),
    })


def metric_value(attributes: Column) -> Column:
    """The value of a metric event as a number."""
    return attributes["metric_value"].try_cast("double")


def trace_export(exports: DataFrame) -> DataFrame:
    """Nested trace exports to one telemetry row per span."""
    resource = exports.select(F.explode("resourceSpans").alias("r"))
    # the last attribute of that key wins
    names = F.filter(F.col("r.resource.attributes"), lambda a: a["key"] == "service.name")
    service = F.when(F.size(names) > 0, F.coalesce(F.element_at(names, -1)["value"]["stringValue"], F.lit("")))
    flat = (
        resource.select(F.coalesce(service, F.lit("unknown")).alias("service"), F.explode("r.scopeSpans").alias("s"))
        .select("service", F.explode("s.spans").alias("span"))
    )
    hexed = lambda c: F.lower(F.hex(F.col(c)))
    return _shape(flat, {
        "event_id": stable_event_id(hexed("span.traceId"), hexed("span.spanId")),
        "service_name": F.col("service"),
        "environment": F.lit("prod"),
        "event_type": F.lit("trace"),
        "timestamp": F.timestamp_millis(F.expr("span.startTimeUnixNano div 1000000")),
        "message": F.col("span.name"),
        "trace_id": hexed("span.traceId"),
        "span_id": hexed("span.spanId"),
        "attributes": F.create_map(F.lit("span_kind"), F.col("span.kind")),
    })


def log_batches(batches: DataFrame, body: str = "body", received: str = "received_at") -> tuple[DataFrame, DataFrame]:
    """Bodies holding a JSON array of log objects: (telemetry rows, rejected bodies).

    A value that is no string counts as absent for service, message and severity.
    """
    parsed = batches.withColumn("_logs", F.from_json(F.col(body), "array<map<string,string>>")).withColumn(
        "_types", F.from_json(F.col(body), "array<struct<service:variant,message:variant,severity:variant>>")
    )
    good = parsed.filter(F.col("_logs").isNotNull())
    bad = parsed.filter(F.col("_logs").isNull()).select(
        F.col(body).alias("original"), F.lit("Invalid JSON").alias("reason"), F.col(received).alias("timestamp")
    )
    rows = good.select(
        F.col(received).alias("_at"), F.col(body).alias("_body"),
        F.posexplode(F.arrays_zip("_logs", "_types")).alias("_pos", "_e"),
    )

    def text(field: str, default: str) -> Column:
        value = F.col("_e")["_types"][field]
        is_string = F.schema_of_variant(value) == "STRING"
        return F.when(is_string, F.variant_get(value, "$", "string")).otherwise(F.lit(default))

    return (
        _shape(rows, {
            "event_id": stable_event_id(F.col("_body"), F.unix_micros("_at"), F.col("_pos")),
            "service_name": text("service", "unknown"),
            "environment": F.lit("prod"),
            "event_type": F.lit("log"),
            "timestamp": F.col("_at"),
            "severity": text("severity", "INFO"),
            "message": text("message", ""),
            "attributes": F.col("_e")["_logs"],
        }),
        bad,
    )


def union_collectors(*sources: DataFrame) -> DataFrame:
    """One telemetry set from all collectors."""
    return reduce(lambda a, b: a.unionByName(b), [s.select(*_COLUMNS) for s in sources])


def split_oversize(events: DataFrame, limit: int = OVERSIZE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, blobs to store): a message above the limit moves to a blob and
    its row keeps the key."""
    big = F.octet_length("message") > limit
    key = F.concat(F.lit("raw/"), F.to_date("timestamp").cast("string"), F.lit("/"), F.col("event_id"))
    kept = events.withColumns(
        {
            "raw_blob_s3_key": F.when(big, key).otherwise(F.col("raw_blob_s3_key")),
            "message": F.when(big, F.lit(None).cast("string")).otherwise(F.col("message")),
        }
    )
    blobs = events.filter(big).select(key.alias("key"), "message")
    return kept, blobs


def with_blobs(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows with their whole messages again: those that moved to a blob come back by key."""
    stored = blobs.select(F.col("key").alias("raw_blob_s3_key"), F.col("message").alias("_blob")).dropDuplicates(["raw_blob_s3_key"])
    # rows without a key meet nothing; in the join they would be one group of one task
    moved = F.col("raw_blob_s3_key").isNotNull()
    met = rows.filter(moved).join(stored, "raw_blob_s3_key", "left").withColumn("message", F.coalesce("message", "_blob"))
    return rows.filter(~moved).unionByName(met.select(*rows.columns))
