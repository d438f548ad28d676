"""Validity, capsules, samples."""

from pyspark.sql import functions as F

from tidegauge.constants import ENVIRONMENTS, EVENT_TYPES, SEVERITIES
from tidegauge.functions.scoring import capsule_confidence
from tidegauge.functions.text import redact
from tidegauge.operators import capsules as cp
from tidegauge.operators.governance import domain_violations
from tidegauge.operators.quality import in_window
from tidegauge.plans.ctes import CAPSULES, FP, TEL, redact_sql
from tidegauge.plans.registry import joined, map_text, query, r6, stamp
from tidegauge.sources import adapters

_SHOWN = """fingerprint_hash, template, service_name, severity, count, severity_distribution, sample_event_ids,
  strftime(time_bucket, '%Y-%m-%d %H:%M:%S') AS time_bucket, strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at,
  strftime(last_seen_at, '%Y-%m-%d %H:%M:%S') AS last_seen_at"""


def shown(caps, *extra):
    return caps.select(
        "fingerprint_hash", "template", "service_name", "severity", "count", map_text("severity_distribution"),
        joined("sample_event_ids"), stamp("time_bucket"), stamp("first_seen_at"), stamp("last_seen_at"), *extra,
    )


@query("hourly_capsules", f"WITH {CAPSULES} SELECT {_SHOWN} FROM cap")
def hourly_capsules(spark, d):
    return shown(cp.build_capsules(adapters.telemetry(spark, d)))


@query("latest_capsules", f"""
WITH {CAPSULES}, l AS (
  SELECT *, row_number() OVER (PARTITION BY fingerprint_hash, service_name ORDER BY time_bucket DESC) AS recency FROM cap)
SELECT {_SHOWN}, recency FROM l WHERE recency <= 10""")
def latest_capsules(spark, d):
    return shown(cp.latest_capsules(cp.build_capsules(adapters.telemetry(spark, d))), "recency")


@query("uniform_samples", f"""
WITH {TEL}, s AS (
  SELECT service_name, severity, event_id, row_number() OVER (PARTITION BY service_name, severity ORDER BY md5(event_id), event_id) AS sample_rank
  FROM tel)
SELECT * FROM s WHERE sample_rank <= 10""")
def uniform_samples(spark, d):
    rows = adapters.telemetry(spark, d).select("service_name", "severity", "event_id")
    return cp.bottom_k(rows, ["service_name", "severity"], "event_id").drop("sample_hash")


def raw_events(spark, d):
    """Telemetry with the faults a collector may send."""
    e = F.col("event_id").cast("bigint")
    return adapters.telemetry(spark, d).withColumns(
        {
            "service_name": F.when(e % 101 == 0, None).otherwise(F.col("service_name")),
            "timestamp": F.when(e % 103 == 0, None).otherwise(F.col("timestamp")),
            "environment": F.when(e % 107 == 0, "qa").otherwise(F.col("environment")),
            "severity": F.when(e % 109 == 0, "TRACE").otherwise(F.col("severity")),
        }
    )


_RAW = TEL + """,
raw AS (
  SELECT event_id, event_type, kind, CASE WHEN eid % 101 = 0 THEN NULL ELSE service_name END AS service_name,
    CASE WHEN eid % 103 = 0 THEN NULL ELSE ts END AS ts, CASE WHEN eid % 107 = 0 THEN 'qa' ELSE environment END AS environment,
    CASE WHEN eid % 109 = 0 THEN 'TRACE' ELSE severity END AS severity
  FROM tel),
judged AS (
  SELECT *, CASE WHEN service_name IS NULL THEN 'missing service_name' WHEN ts IS NULL THEN 'missing timestamp'
    WHEN environment = 'qa' THEN 'bad environment' WHEN severity = 'TRACE' THEN 'bad severity' END AS reason FROM raw)"""


@query("valid_events", f"""
WITH {_RAW} SELECT event_type, severity, count(*) AS events FROM judged WHERE reason IS NULL GROUP BY ALL""")
def valid_events(spark, d):
    return cp.split_valid(raw_events(spark, d))[0].groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("events"))


@query("dead_letters", f"""
WITH {_RAW} SELECT event_id, reason FROM judged WHERE reason IS NOT NULL""")
def dead_letters(spark, d):
    dead = cp.split_valid(raw_events(spark, d), F.lit("2024-02-01").cast("timestamp"))[1]
    return dead.select(F.get_json_object("original", "$.event_id").alias("event_id"), "reason")


@query("domain_violations", f"""
WITH {_RAW} SELECT rule, count(*) AS events FROM (
  SELECT 'environment' AS rule FROM raw WHERE environment = 'qa'
  UNION ALL SELECT 'severity' FROM raw WHERE severity = 'TRACE'
  UNION ALL SELECT 'service' FROM raw WHERE service_name IS NULL) GROUP BY rule""")
def domain_rules(spark, d):
    rules = {
        "environment": F.col("environment").isin(ENVIRONMENTS),
        "event_type": F.col("event_type").isin(EVENT_TYPES),
        "severity": F.col("severity").isin(SEVERITIES),
        "service": F.col("service_name").isNotNull(),
    }
    return domain_violations(raw_events(spark, d), "event_id", rules).groupBy("rule").agg(F.count(F.lit(1)).alias("events"))


@query("capsule_confidence", f"""
WITH {CAPSULES} SELECT capsule_id, count, redaction_hit,
  round(least(100, least(100, log10(greatest(1, count)) * 25) * CASE WHEN redaction_hit THEN 1.1 ELSE 1 END), 6) AS confidence
FROM cap""")
def capsule_confidence_query(spark, d):
    rows = cp.hourly_fingerprints(adapters.telemetry(spark, d))
    counted = rows.groupBy(*cp.KEY).agg(F.count(F.lit(1)).alias("count"), F.bool_or("redaction_hit").alias("redaction_hit"))
    return counted.select(
        cp.capsule_id().alias("capsule_id"), "count", "redaction_hit",
        r6(capsule_confidence(F.col("count"), F.col("redaction_hit"))).alias("confidence"),
    )


@query("embedding_gate", f"""
WITH {TEL}, r AS (SELECT service_name, severity <> 'WARN' AS checked, message <> {redact_sql('message')} AS hit FROM tel)
SELECT service_name, count(*) FILTER (checked) AS admitted, count(*) FILTER (checked AND NOT hit) AS admitted_clean, count(*) FILTER (NOT checked) AS refused
FROM r GROUP BY service_name""")
def embedding_gate(spark, d):
    """Warnings stand for a feed that skips redaction; its text is refused, clean text of the others is not."""
    events = adapters.telemetry(spark, d).select("service_name", "severity", "message")
    warning = F.col("severity") == "WARN"
    skipped = events.filter(warning).withColumn("redaction_hit", F.lit(False))
    rows = redact(events.filter(~warning), "message").unionByName(skipped, allowMissingColumns=True)
    admitted, refused = cp.ready_for_embedding(rows)
    kept = admitted.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("admitted"), F.count_if(~F.col("redaction_hit")).alias("admitted_clean")
    )
    out = kept.join(refused.groupBy("service_name").agg(F.count(F.lit(1)).alias("refused")), "service_name", "full")
    return out.fillna(0, ["admitted", "admitted_clean", "refused"])


@query("capsules_by_service_id", f"""
WITH {FP}, c AS (SELECT DISTINCT fingerprint_hash, service_name, time_bucket FROM fp),
s AS (SELECT s_suppkey AS service_id, 'svc-' || s_suppkey AS name FROM supplier WHERE s_acctbal >= 0)
SELECT coalesce(CAST(service_id AS VARCHAR), 'none') AS service_id, c.service_name, count(*) AS capsules
FROM c LEFT JOIN s ON c.service_name = s.name GROUP BY ALL""")
def capsules_by_service_id(spark, d):
    caps = cp.hourly_fingerprints(adapters.telemetry(spark, d)).select(*cp.KEY).distinct()
    known = adapters.services(spark, d).filter("status = 'active'")
    found, missed = cp.with_service_id(caps, known)
    both = found.select("service_name", F.col("service_id").cast("string").alias("service_id")).unionByName(
        missed.select("service_name", F.lit("none").alias("service_id"))
    )
    return both.groupBy("service_id", "service_name").agg(F.count(F.lit(1)).alias("capsules"))


@query("capsules_in_window", f"""
WITH {CAPSULES} SELECT service_name, count(*) AS capsules, CAST(sum(count) AS BIGINT) AS events FROM (
  SELECT service_name, count FROM cap
  WHERE time_bucket BETWEEN TIMESTAMP '2024-01-31' - INTERVAL 14 DAY AND TIMESTAMP '2024-01-31') GROUP BY ALL""")
def capsules_in_window(spark, d):
    caps = cp.capsule_counts(cp.hourly_fingerprints(adapters.telemetry(spark, d)))
    return caps.filter(in_window("time_bucket", "2024-01-31", 14)).groupBy("service_name").agg(
        F.count(F.lit(1)).alias("capsules"), F.sum("count").alias("events")
    )
