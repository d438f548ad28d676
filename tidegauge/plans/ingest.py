"""Collector mappings."""

from pyspark.sql import functions as F

from tidegauge.plans.ctes import REQ, SPANS, TEL
from tidegauge.plans.registry import query
from tidegauge.sources import adapters, ingest
from tidegauge.sources.tables import table


def metric_rows(spark, d):
    ev = table(spark, d, "events")
    return ev.select(
        F.concat(F.lit("app_"), F.col("event_type")).alias("metric_name"),
        F.create_map(F.lit("job"), F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")), F.lit("event"), F.col("event_id").cast("string")).alias("labels"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("value"),
    )


@query("metric_sample_ingest", """
SELECT 'svc-' || (user_id % 8) AS service_name, 'prod' AS environment, 'metric' AS event_type, 'INFO' AS severity,
  'app_' || event_type || '=' || printf('%.6f', value) AS message, value AS metric_value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM events""")
def metric_sample_ingest(spark, d):
    t = ingest.metric_samples(metric_rows(spark, d))
    return t.select(
        "service_name", "environment", "event_type", "severity", "message", ingest.metric_value(F.col("attributes")).alias("metric_value"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )


def exports(spark, d):
    """Exports of the order spans, one resource each."""
    spans = adapters.spans(spark, d)
    span = F.struct(
        F.unhex(F.lpad("trace_id", 16, "0")).alias("traceId"), F.unhex(F.lpad("span_id", 8, "0")).alias("spanId"), F.col("span_name").alias("name"),
        F.lit("SPAN_KIND_SERVER").alias("kind"), (F.lit(1704067200000000000) + F.col("trace_id").cast("bigint") * 1000000).alias("startTimeUnixNano"),
    )
    # an export carries at most a hundred spans of one service
    chunk = F.floor(F.col("span_id").cast("int") / 100).alias("chunk")
    per_service = spans.groupBy("trace_id", "service_name", chunk).agg(F.collect_list(span).alias("spans"))
    attr = F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service_name").alias("stringValue")).alias("value"))
    none = F.array().cast("array<struct<key:string,value:struct<stringValue:string>>>")
    resource = F.struct(
        F.struct(F.when(F.col("service_name") == "svc-0", none).otherwise(F.array(attr)).alias("attributes")).alias("resource"),
        F.array(F.struct(F.col("spans"))).alias("scopeSpans"),
    )
    return per_service.select(F.array(resource).alias("resourceSpans"))


@query("trace_export_ingest", f"""
WITH {SPANS} SELECT CASE service_name WHEN 'svc-0' THEN 'unknown' ELSE service_name END AS service_name, lpad(trace_id, 16, '0') AS trace_id, lpad(span_id, 8, '0') AS span_id,
  span_name AS message, 'SPAN_KIND_SERVER' AS span_kind, 1704067200000 + CAST(trace_id AS BIGINT) AS ms FROM spans""")
def trace_export_ingest(spark, d):
    t = ingest.trace_export(exports(spark, d))
    return t.select("service_name", "trace_id", "span_id", "message", F.col("attributes")["span_kind"].alias("span_kind"), F.unix_millis("timestamp").alias("ms"))


def bodies(spark, d):
    """One request body per conversation turn; system turns send broken JSON."""
    conv = table(spark, d, "conversations")
    logs = F.to_json(F.array(F.struct(
        F.when(F.col("role") == "user", F.col("role")).alias("service"), F.col("text").alias("message"),
        F.when(F.col("turn") > 0, "WARN").alias("severity"),
    )))
    return conv.select(
        "conv_id", "turn", F.when(F.col("role") == "system", F.concat(F.lit("{"), "text")).otherwise(logs).alias("body"),
        F.lit("2024-01-01").cast("timestamp").alias("received_at"),
    )


@query("log_batch_ingest", """
SELECT CASE WHEN role = 'user' THEN 'user' ELSE 'unknown' END AS service_name, CASE WHEN turn > 0 THEN 'WARN' ELSE 'INFO' END AS severity, sha256(text) AS message_hash
FROM conversations WHERE role <> 'system'""")
def log_batch_ingest(spark, d):
    good, _ = ingest.log_batches(bodies(spark, d))
    return good.select("service_name", "severity", F.sha2("message", 256).alias("message_hash"))


@query("log_batch_rejects", "SELECT sha256('{' || text) AS body_hash, 'Invalid JSON' AS reason FROM conversations WHERE role = 'system'")
def log_batch_rejects(spark, d):
    _, bad = ingest.log_batches(bodies(spark, d))
    return bad.select(F.sha2("original", 256).alias("body_hash"), "reason")


@query("all_collectors", f"""
WITH {SPANS} SELECT event_type, count(*) AS events FROM (
  SELECT 'metric' AS event_type FROM events UNION ALL SELECT 'trace' FROM spans UNION ALL SELECT 'log' FROM conversations WHERE role <> 'system') GROUP BY event_type""")
def all_collectors(spark, d):
    logs, _ = ingest.log_batches(bodies(spark, d))
    both = ingest.union_collectors(ingest.metric_samples(metric_rows(spark, d)), ingest.trace_export(exports(spark, d)), logs)
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("oversize_split", """
SELECT doc_id, CASE WHEN strlen(text) > 102400 THEN -1 ELSE strlen(text) END AS kept_bytes,
  CASE WHEN strlen(text) > 102400 THEN 'raw/2024-01-01/' || doc_id ELSE 'inline' END AS blob_key FROM documents""")
def oversize_split(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("event_id"), F.col("text").alias("message"),
        F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("raw_blob_s3_key"),
    )
    kept, _ = ingest.split_oversize(rows)
    return kept.select(
        F.col("event_id").cast("bigint").alias("doc_id"), F.coalesce(F.octet_length("message"), F.lit(-1)).alias("kept_bytes"),
        F.coalesce("raw_blob_s3_key", F.lit("inline")).alias("blob_key"),
    )
