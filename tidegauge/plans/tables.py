"""Stored tables: writes, reads back, upkeep."""

from pyspark.sql import functions as F

from tidegauge.operators import capsules as cp
from tidegauge.plans.capsules import _SHOWN, shown
from tidegauge.plans.ctes import CAPSULES, FP, TEL, VEC
from tidegauge.plans.metrics import objective_history
from tidegauge.plans.registry import query
from tidegauge.session import workspace
from tidegauge.sources import adapters, stores
from tidegauge.sources.versions import VersionedTable

TS = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def bare(spark, d):
    """Capsules without samples: key, count, times."""
    return cp.capsule_counts(cp.hourly_templates(adapters.telemetry(spark, d))).select(
        "fingerprint_hash", "service_name", "time_bucket", "count", "severity", "first_seen_at", "last_seen_at"
    )


@query("capsule_upsert", f"""
WITH {CAPSULES} SELECT fingerprint_hash, service_name, strftime(time_bucket, '%Y-%m-%d %H:%M:%S') AS time_bucket,
  CASE WHEN severity = 'ERROR' THEN count * 10 ELSE count END AS count FROM cap""")
def capsule_upsert(spark, d):
    path = workspace(spark, "capsule-table")
    caps = bare(spark, d)
    stores.upsert(path, caps, cp.KEY, "time_bucket")
    changed = caps.filter("severity = 'ERROR'").withColumn("count", F.col("count") * 10)
    stores.upsert(path, changed, cp.KEY, "time_bucket")
    stores.upsert(path, changed, cp.KEY, "time_bucket")  # a replay leaves the same table
    return stores.read_table(spark, path).select("fingerprint_hash", "service_name", TS("time_bucket"), "count")


@query("sample_files", f"""
WITH {FP}, r AS (SELECT fingerprint_hash, service_name, time_bucket, event_id, row_number() OVER (PARTITION BY fingerprint_hash, service_name, time_bucket ORDER BY h, event_id) AS rk FROM fp)
SELECT fingerprint_hash, service_name, CAST(epoch(time_bucket) AS BIGINT) AS bucket, event_id FROM r WHERE rk <= 10""")
def sample_files(spark, d):
    path = workspace(spark, "samples")
    caps = cp.capsule_samples(cp.hourly_templates(adapters.telemetry(spark, d))).select(
        F.sha2("template", 256).alias("fingerprint_hash"), "service_name", "time_bucket",
        stores.expand_sample_ids(F.col("sample_event_ids"), F.col("time_bucket")).alias("sample_array"),
    )
    stores.write_samples(caps, path)
    return stores.read_samples(spark, path).select("fingerprint_hash", "service_name", "bucket", F.col("sample")["event_id"].alias("event_id"))


@query("vector_store", f"""
WITH {VEC} SELECT environment, severity, count(*) AS num_entities FROM vec WHERE severity <> 'ERROR' OR environment = 'dev' GROUP BY ALL""")
def vector_store(spark, d):
    """Errors are deleted, those of one environment inserted again; every step is repeated, as by a writer that was stopped."""
    path, v = workspace(spark, "vectors"), adapters.vectors(spark, d)
    errors = v.filter("severity = 'ERROR'")
    for _ in range(2):
        stores.insert_vectors(v, path, "pipeline", 0)
    for _ in range(2):
        stores.delete_vectors(spark, path, errors.select("environment", "capsule_id"), "pipeline", 1)
    for _ in range(2):
        stores.insert_vectors(errors.filter("environment = 'dev'"), path, "pipeline", 2)
    stores.compact_vectors(spark, path)
    return stores.read_vectors(spark, path).groupBy("environment", "severity").agg(F.count(F.lit(1)).alias("num_entities"))


@query("collection_stats", "SELECT 'capsules' AS collection_name, count(*) AS num_entities FROM embeddings")
def collection_stats(spark, d):
    return stores.collection_stats(adapters.vectors(spark, d))


@query("retention", f"""
WITH {FP}, k AS (SELECT DISTINCT fingerprint_hash, service_name, time_bucket FROM fp WHERE time_bucket >= DATE '2024-04-15' - 90)
SELECT strftime(time_bucket, '%Y-%m-%d') AS day, count(*) AS capsules FROM k GROUP BY ALL""")
def retention(spark, d):
    path = workspace(spark, "capsule-table")
    stores.upsert(path, bare(spark, d), cp.KEY, "time_bucket")
    stores.upkeep(spark, path, "capsules", "2024-04-15")
    return stores.read_table(spark, path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("capsules"))


@query("raw_retention", f"WITH {TEL} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM tel WHERE ts >= DATE '2024-01-20' - 7 GROUP BY ALL")
def raw_retention(spark, d):
    path = workspace(spark, "raw-table")
    raw = adapters.telemetry(spark, d).withColumn("day", F.to_date("timestamp"))
    VersionedTable(spark, path).append(raw, "collector", 0)
    stores.upkeep(spark, path, "raw", "2024-01-20")
    return stores.read_table(spark, path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("events"))


def objective_table(spark, d):
    """Objectives by month of creation, the policy applied as of the last day."""
    path = workspace(spark, "objective-table")
    history = objective_history(spark, d).withColumn("month", F.date_format("created_at", "yyyy-MM"))
    VersionedTable(spark, path, "month").append(history, "objectives", 0)
    as_of = history.agg(F.max(F.to_date("created_at"))).first()[0]
    return path, stores.upkeep(spark, path, "objectives", as_of)


@query("objective_retention", """
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, max(o_orderdate) OVER () AS last FROM orders)
SELECT month, count(*) AS objectives FROM o WHERE month >= strftime(last - INTERVAL 365 DAY, '%Y-%m') GROUP BY month""")
def objective_retention(spark, d):
    return stores.read_table(spark, objective_table(spark, d)[0], "month").groupBy("month").agg(F.count(F.lit(1)).alias("objectives"))


@query("objective_compaction", """
WITH o AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS p, max(o_orderdate) OVER () AS last FROM orders)
SELECT 'sli-' || o_custkey AS sli_id, month < strftime(last - INTERVAL 30 DAY, '%Y-%m') AS compact, count(*) AS objectives, round(sum(p / 1000), 6) AS budget
FROM o WHERE month >= strftime(last - INTERVAL 365 DAY, '%Y-%m') GROUP BY ALL""")
def objective_compaction(spark, d):
    path, done = objective_table(spark, d)
    rows = stores.read_table(spark, path, "month").withColumn("compact", F.col("month").isin(done["rewritten"]))  # one value per month
    return rows.groupBy("sli_id", "compact").agg(F.count(F.lit(1)).alias("objectives"), F.round(F.sum("error_budget_remaining"), 6).alias("budget"))


@query("compaction", f"""
WITH {FP}, k AS (SELECT fingerprint_hash, service_name, time_bucket, count(*) AS n FROM fp WHERE time_bucket >= DATE '2024-02-05' - 90 GROUP BY ALL)
SELECT service_name, time_bucket < DATE '2024-02-05' - 7 AS compact, count(*) AS capsules, CAST(sum(n) AS BIGINT) AS events FROM k GROUP BY ALL""")
def compaction(spark, d):
    path = workspace(spark, "capsule-table")
    stores.upsert(path, bare(spark, d), cp.KEY, "time_bucket")
    done = stores.upkeep(spark, path, "capsules", "2024-02-05")
    rows = stores.read_table(spark, path).withColumn("compact", F.col("day").cast("string").isin(done["rewritten"]))  # one value per day
    return rows.groupBy("service_name", "compact").agg(F.count(F.lit(1)).alias("capsules"), F.sum("count").alias("events"))


@query("table_stats", "SELECT 'events' AS table_name, count(*) AS row_count, TRUE AS has_chunks, TRUE AS has_bytes FROM events")
def table_stats(spark, d):
    from tidegauge.sources.tables import table

    s = stores.table_stats(table(spark, d, "events"), "events")
    return s.select("table_name", "row_count", (F.col("num_chunks") >= 1).alias("has_chunks"), (F.col("total_size") > 0).alias("has_bytes"))


@query("incremental_summary", """
WITH o AS (SELECT 'sli-' || o_custkey AS sli_id, o_orderdate AS created_at, o_totalprice / 1000 AS b, max(o_orderdate) OVER () AS last FROM orders WHERE o_orderstatus = 'F')
SELECT sli_id, strftime(created_at, '%Y-%m-%d') AS bucket, count(*) AS slo_count,
  round(avg(CASE WHEN created_at >= date_trunc('month', last - INTERVAL 3 DAY) THEN b + 1 ELSE b END), 8) AS avg_budget_remaining FROM o GROUP BY ALL""")
def incremental_summary(spark, d):
    path = workspace(spark, "summary")
    history = objective_history(spark, d)
    last = history.filter("deployed_at is not null").agg(F.max("created_at")).first()[0]
    now = last.replace(hour=23)
    stores.refresh_summary(path, history, now, start_days=36500)
    # budgets change; only the partitions of the refresh window are recomputed
    stores.refresh_summary(path, history.withColumn("error_budget_remaining", F.col("error_budget_remaining") + 1), now, start_days=3)
    return spark.read.parquet(path).select(
        "sli_id", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "slo_count", F.round("avg_budget_remaining", 8).alias("avg_budget_remaining")
    )


@query("staged_capsules", f"WITH {CAPSULES} SELECT {_SHOWN} FROM cap")
def staged_capsules(spark, d):
    return shown(cp.build_capsules(adapters.telemetry(spark, d), stage=True))
