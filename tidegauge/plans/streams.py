"""Streaming jobs run to the end of their input; results equal the batch operators."""

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import capsules as cp
from tidegauge.operators.vectors import embed_with
from tidegauge.plans.capsules import _RAW, _SHOWN, raw_events, shown
from tidegauge.plans.ctes import CAPSULES, FP
from tidegauge.plans.registry import map_text, query, stamp
from tidegauge.session import workspace
from tidegauge.sources import adapters, ingest, stores
from tidegauge.streaming import jobs, sinks

ONCE = {"availableNow": True}


def streamed(spark, df, purpose):
    """Lands rows as files, the input of a file stream."""
    path = workspace(spark, purpose)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def finish(q):
    q.awaitTermination()


def encoded(spark, d):
    """Telemetry as JSON values in text files, every 50th with a broken copy; the input of a text stream."""
    events = adapters.telemetry(spark, d).drop("attributes")
    value = F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    broken = F.when(F.col("event_id").cast("bigint") % 50 == 0, F.concat(F.lit('{"event_id": "'), F.col("event_id"), F.lit('", "timestamp": "soon"}')))
    path = workspace(spark, "raw-telemetry")
    events.select(F.explode(F.array_compact(F.array(value, broken))).alias("value")).write.text(path)
    return jobs.telemetry_stream(spark, "text", path)


@query("stream_capsules", f"WITH {CAPSULES} SELECT {_SHOWN} FROM cap")
def stream_capsules(spark, d):
    events, _ = jobs.decoded(encoded(spark, d))
    path = workspace(spark, "capsules")
    finish(jobs.start_capsules(events, path, workspace(spark, "checkpoint"), ONCE))
    return shown(jobs.read_capsules(spark, path))


@query("stream_undecodable", """
SELECT '{"event_id": "' || event_id || '", "timestamp": "soon"}' AS value, 'undecodable' AS reason FROM events WHERE event_id % 50 = 0""")
def stream_undecodable(spark, d):
    path = workspace(spark, "dead-letters")
    finish(jobs.start_undecodable(encoded(spark, d), path, workspace(spark, "checkpoint"), ONCE))
    return jobs.read_batches(spark, path).select(F.col("value").cast("string").alias("value"), "reason")


@query("stream_oversize", """
SELECT CAST(doc_id AS VARCHAR) AS event_id, md5(text) AS message, CASE WHEN strlen(text) > 8192 THEN 'raw/2024-01-01/' || doc_id END AS blob_key,
  CASE WHEN source = 'src1' THEN 'bad environment' END AS reason FROM documents WHERE text IS NOT NULL""")
def stream_oversize(spark, d):
    """Documents as messages, those of one source refused; messages above 8 KB go to blobs and are joined back."""
    from tidegauge.sources.tables import table

    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(
        F.col("doc_id").cast("string").alias("event_id"), F.lit("svc").alias("service_name"),
        F.when(F.col("source") == "src1", "nowhere").otherwise("prod").alias("environment"), F.lit("log").alias("event_type"),
        F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.lit("INFO").alias("severity"), F.col("text").alias("message"),
        F.lit(None).cast("string").alias("raw_blob_s3_key"),
    )
    rows, blobs, dead = (workspace(spark, p) for p in ("rows", "blobs", "dead-letters"))
    finish(streamed(spark, docs, "raw-telemetry").writeStream.option("checkpointLocation", workspace(spark, "checkpoint"))
           .foreachBatch(sinks.oversize_writer(rows, blobs, dead, 8192)).trigger(**ONCE).start())
    whole = ingest.with_blobs(jobs.read_batches(spark, rows), jobs.read_batches(spark, blobs))
    good = whole.select("event_id", F.md5("message").alias("message"), F.col("raw_blob_s3_key").alias("blob_key"), F.lit(None).cast("string").alias("reason"))
    field = lambda name: F.get_json_object("original", f"$.{name}")
    message = field("message")
    bad = jobs.read_batches(spark, dead).select(
        field("event_id").alias("event_id"), F.md5(message).alias("message"),
        F.when(F.octet_length(message) > 8192, F.concat(F.lit("raw/2024-01-01/"), field("event_id"))).alias("blob_key"), "reason")
    return good.unionByName(bad)


@query("stream_fallback", f"WITH {FP} SELECT service_name, CASE WHEN severity = 'ERROR' THEN 'fallback' ELSE 'stored' END AS branch, count(*) AS events FROM fp GROUP BY ALL")
def stream_fallback(spark, d):
    """Errors arrive in files of their own, and the store is down whenever it is given one."""
    rows = adapters.telemetry(spark, d).select("event_id", "service_name", "severity")
    path = workspace(spark, "events")
    for n, part in enumerate((rows.filter("severity <> 'ERROR'"), rows.filter("severity = 'ERROR'"))):
        part.coalesce(1).write.parquet(f"{path}/part-{n}")
    good, spare = workspace(spark, "stored"), workspace(spark, "fallback")
    keep = sinks.batch_writer(good)

    def store(df, batch_id):
        if not df.filter("severity = 'ERROR'").isEmpty():
            raise RuntimeError("store is down")
        keep(df, batch_id)

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part-*")
    finish(stream.writeStream.option("checkpointLocation", workspace(spark, "checkpoint"))
           .foreachBatch(sinks.with_fallback(store, sinks.batch_writer(spare))).trigger(**ONCE).start())
    both = jobs.read_batches(spark, good).withColumn("branch", F.lit("stored")).unionByName(
        jobs.read_batches(spark, spare).filter("error = 'store is down'").drop("error").withColumn("branch", F.lit("fallback")))
    return both.groupBy("service_name", "branch").agg(F.count(F.lit(1)).alias("events"))


@query("stream_running_totals", f"""
WITH {CAPSULES} SELECT fingerprint_hash, service_name, strftime(time_bucket, '%Y-%m-%d %H:%M:%S') AS time_bucket, count, severity, severity_distribution FROM cap""")
def stream_running_totals(spark, d):
    events = streamed(spark, adapters.telemetry(spark, d).drop("attributes"), "raw-telemetry")
    path = workspace(spark, "totals")
    finish(jobs.start_totals(events, path, workspace(spark, "checkpoint"), ONCE))
    return jobs.read_totals(spark, path).select(
        "fingerprint_hash", "service_name", stamp("time_bucket"), "count", "severity", map_text("severity_distribution")
    )


@query("stream_dead_letters", f"WITH {_RAW} SELECT event_id, reason FROM judged WHERE reason IS NOT NULL")
def stream_dead_letters(spark, d):
    events = streamed(spark, raw_events(spark, d).drop("attributes"), "raw-telemetry")
    path = workspace(spark, "dead-letters")
    finish(jobs.start_dead_letters(events, path, workspace(spark, "checkpoint"), ONCE))
    return jobs.read_batches(spark, path).select(F.get_json_object("original", "$.event_id").alias("event_id"), "reason")


@query("stream_split", f"""
WITH {_RAW} SELECT CASE WHEN reason IS NULL THEN 'valid' ELSE 'dead' END AS branch, count(*) AS events FROM judged GROUP BY ALL""")
def stream_split(spark, d):
    events = streamed(spark, raw_events(spark, d).drop("attributes"), "raw-telemetry")
    good, dead = workspace(spark, "valid"), workspace(spark, "dead")
    finish(events.writeStream.option("checkpointLocation", workspace(spark, "checkpoint")).foreachBatch(
        sinks.split_writer(good, dead)).trigger(**ONCE).start())
    both = jobs.read_batches(spark, good).select(F.lit("valid").alias("branch")).unionByName(
        jobs.read_batches(spark, dead).select(F.lit("dead").alias("branch")))
    return both.groupBy("branch").agg(F.count(F.lit(1)).alias("events"))


class LetterEmbedder:
    """A stand-in model: letter counts folded into ``dimension`` slots."""

    name = "letters"

    def __init__(self, dimension: int = 26):
        self.dimension = dimension

    def embed(self, texts):
        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for i, text in enumerate(texts):
            codes = np.frombuffer(text.lower().encode("ascii", "ignore"), dtype=np.uint8)
            letters = codes[(codes >= 97) & (codes <= 122)] - 97
            np.add.at(out[i], letters % self.dimension, 1)
        return out


@query("stream_embeddings", f"""
WITH {FP}, t AS (SELECT fingerprint_hash, template, service_name, min(environment) AS environment, bool_and(severity <> 'WARN') AS ok FROM fp GROUP BY ALL)
SELECT md5(fingerprint_hash || '|' || service_name) AS capsule_id, fingerprint_hash, environment, CASE WHEN ok THEN 'embedded' ELSE 'refused' END AS branch,
  CASE WHEN ok THEN 26 ELSE 0 END AS dimension, CASE WHEN ok THEN 'letters' END AS embedding_model FROM t""")
def stream_embeddings(spark, d):
    rows = cp.hourly_fingerprints(adapters.telemetry(spark, d))
    # patterns that also came from warnings, which stand for a feed that skips redaction, are not cleared
    patterns = rows.groupBy("fingerprint_hash", "template", "service_name").agg(
        F.min("environment").alias("environment"), F.bool_and(F.col("severity") != "WARN").alias("redaction_applied"))
    patterns = patterns.withColumn("capsule_id", F.md5(F.concat_ws("|", "fingerprint_hash", "service_name")))
    stream = streamed(spark, patterns, "capsule-events")
    vectors, fallback, refused = (workspace(spark, p) for p in ("vectors", "fallback", "refused"))
    finish(jobs.start_embeddings(stream, LetterEmbedder(), vectors, fallback, refused, workspace(spark, "checkpoint"), ONCE))
    columns = ["capsule_id", "fingerprint_hash", "environment"]
    return stores.read_vectors(spark, vectors).select(
        *columns, F.lit("embedded").alias("branch"), F.size("embedding_vector").alias("dimension"), "embedding_model"
    ).unionByName(jobs.read_batches(spark, refused).select(
        *columns, F.lit("refused").alias("branch"), F.lit(0).alias("dimension"), F.lit(None).cast("string").alias("embedding_model")))


@query("model_embeddings", f"""
WITH {FP}, w AS (SELECT DISTINCT fingerprint_hash, template FROM fp),
l AS (SELECT fingerprint_hash, unnest(regexp_extract_all(lower(template), '[a-z]')) AS c FROM w),
n AS (SELECT fingerprint_hash, c, count(*) AS n FROM l GROUP BY ALL)
SELECT fingerprint_hash, c, round(n / sqrt(sum(n * n) OVER (PARTITION BY fingerprint_hash)), 4) AS x FROM n""")
def model_embeddings(spark, d):
    patterns = cp.hourly_templates(adapters.telemetry(spark, d)).select("template").distinct()
    e = embed_with(patterns.select(F.sha2("template", 256).alias("fingerprint_hash"), "template"), "template", LetterEmbedder())
    cells = e.select("fingerprint_hash", F.posexplode("vector").alias("i", "x")).filter("x > 0")
    return cells.select("fingerprint_hash", F.char(F.col("i") + 97).alias("c"), F.round(F.col("x").cast("double"), 4).alias("x"))


@query("stream_consumer", f"""
WITH {CAPSULES}, s AS (SELECT 'svc-' || s_suppkey AS service_name, s_suppkey AS service_id FROM supplier)
SELECT fingerprint_hash, service_id, CAST(epoch(time_bucket) AS BIGINT) AS bucket, len(string_split(sample_event_ids, ',')) AS samples, count,
  CASE WHEN service_id IS NULL THEN 'unknown service' END AS reason FROM cap LEFT JOIN s USING (service_name)""")
def stream_consumer(spark, d):
    caps = cp.build_capsules(adapters.telemetry(spark, d)).select(
        "fingerprint_hash", "template", "service_name", "severity", "count", "sample_event_ids", "time_bucket"
    )
    topic = workspace(spark, "capsule-events")
    caps.select(F.to_json(F.struct("*")).alias("value")).write.text(topic)
    schema = "fingerprint_hash string, template string, service_name string, severity string, count bigint, sample_event_ids array<string>, time_bucket timestamp"
    parsed = spark.readStream.text(topic).select(F.from_json("value", schema).alias("c")).select("c.*")
    named = parsed.withColumn("sample_array", stores.expand_sample_ids(F.col("sample_event_ids"), F.col("time_bucket"))).drop("sample_event_ids")
    services = adapters.services(spark, d)
    table, dead = workspace(spark, "capsules"), workspace(spark, "dead-letters")
    keep, refuse = sinks.upsert_writer(table, ["fingerprint_hash", "service_id", "time_bucket"], "time_bucket"), sinks.batch_writer(dead)

    def each(df, batch_id):
        found, missed = cp.with_service_id(df, services)
        keep(found, batch_id)
        refuse(missed.withColumn("reason", F.lit("unknown service")), batch_id)

    finish(named.writeStream.option("checkpointLocation", workspace(spark, "checkpoint")).foreachBatch(each).trigger(**ONCE).start())
    rows = stores.read_table(spark, table).withColumn("reason", F.lit(None).cast("string"))
    return rows.unionByName(spark.read.parquet(dead).drop("batch_id"), allowMissingColumns=True).select(
        "fingerprint_hash", "service_id", F.unix_seconds("time_bucket").alias("bucket"), F.size("sample_array").alias("samples"), "count", "reason"
    )
