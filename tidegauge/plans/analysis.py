"""Candidate indicators evaluated, and the analysis job."""

from pyspark.sql import functions as F

from tidegauge.constants import HISTOGRAM_BOUNDS, OBJECTIVE_VARIANTS
from tidegauge.operators import analysis as an
from tidegauge.operators import vectors as vc
from tidegauge.operators.evidence import indicator_candidates
from tidegauge.operators.traces import discover_journeys
from tidegauge.plans.ctes import FP, JOURNEYS, SPANS
from tidegauge.plans.registry import query, r6
from tidegauge.plans.vectors import evidence_parts
from tidegauge.session import materialize
from tidegauge.sources import adapters

_BOUNDS = HISTOGRAM_BOUNDS["analysis_seconds"]
DAY = 86400

_SPANS = """
spans AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d%H') AS trace_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS span_id, event_type AS span_name,
    'svc-' || (user_id % 8) AS service_name, value AS duration_ms, ts, event_type = 'error' AS bad,
    lag(lpad(CAST(event_id AS VARCHAR), 12, '0')) OVER (PARTITION BY user_id || '-' || strftime(ts, '%Y%m%d%H') ORDER BY ts, event_id) AS parent_span_id
  FROM events)"""
_JOURNEYS = JOURNEYS.replace(SPANS, _SPANS) + """,
reqs AS (
  SELECT split_part(entry_point, ':', 1) AS job, entry_point AS endpoint, CAST(floor(epoch(first) / 86400) AS BIGINT) * 86400 AS step, root_ms AS seconds, failed
  FROM traces JOIN (SELECT trace_id, min(ts) AS first FROM spans GROUP BY trace_id) USING (trace_id)),
bound AS (SELECT unnest([""" + ", ".join(map(str, [*_BOUNDS, "'Infinity'::DOUBLE"])) + "]) AS le, unnest(range(" + str(len(_BOUNDS) + 1) + """)) AS i),
hist AS (SELECT endpoint, step, i, le, count(*) FILTER (seconds <= le) AS n FROM reqs CROSS JOIN bound GROUP BY ALL),
buckets AS (
  SELECT *, lag(le) OVER w AS low, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY endpoint, step) AS total
  FROM hist WINDOW w AS (PARTITION BY endpoint, step ORDER BY i)),
cand AS (SELECT entry_point, name, confidence_score, entry_point || '|' || name || suffix AS sli_id, q, negated, kind FROM
  (SELECT j.*, least(100, least(70, log10(greatest(1, traffic_volume)) * 10) + least(10, n_samples) + least(20, n_steps * 2)) AS confidence_score FROM journeys j)
  CROSS JOIN (VALUES ('-latency-p50', 0.5, NULL, 'latency'), ('-latency-p95', 0.95, NULL, 'latency'), ('-latency-p99', 0.99, NULL, 'latency'),
    ('-error-rate', NULL, FALSE, 'errors'), ('-availability', NULL, TRUE, 'availability')) AS v(suffix, q, negated, kind)),
val AS (
  SELECT sli_id, step, kind, CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0.0) + (le - coalesce(low, 0.0)) * CASE WHEN n > below THEN (total * q - below) / (n - below) ELSE 0 END END * 1000 AS value
  FROM cand JOIN buckets ON endpoint = entry_point AND n >= total * q WHERE q IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sli_id, step ORDER BY i) = 1
  UNION ALL
  SELECT sli_id, step, any_value(kind), count(*) FILTER (failed <> negated) / count(*) * 100 FROM cand JOIN reqs ON endpoint = entry_point WHERE q IS NULL GROUP BY sli_id, step)"""


def journeys(spark, d):
    return discover_journeys(materialize(adapters.event_spans(spark, d).drop("timestamp"), "spans"))


@query("indicator_values", f"WITH {_JOURNEYS} SELECT sli_id, step, round(value, 6) AS value FROM val")
def indicator_values(spark, d):
    service = F.substring_index("entry_point", ":", 1)
    found = indicator_candidates(journeys(spark, d), service).withColumns({"service_name": service, "sli_id": F.concat_ws("|", "entry_point", "sli_name")})
    series = an.request_series(adapters.event_requests(spark, d), DAY, _BOUNDS)
    return an.indicator_values(found, series).withColumn("value", r6("value"))


_JOB = FP + "," + _JOURNEYS + """,
cc AS (SELECT template, service_name, md5(sha256(template) || '|' || service_name) AS capsule_id FROM fp GROUP BY ALL),
word AS (SELECT capsule_id, unnest(regexp_extract_all(lower(template), '[a-z_]+')) AS w FROM cc),
tf AS (SELECT capsule_id, CAST(('0x' || substr(md5(w), 1, 6)) AS BIGINT) % 384 AS slot, count(*) AS tf FROM word GROUP BY ALL),
idf AS (SELECT slot, ln(((SELECT count(*) FROM cc) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY slot),
w AS (SELECT capsule_id, slot, tf * idf AS w FROM tf JOIN idf USING (slot)),
emb AS (SELECT capsule_id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY capsule_id)) AS x FROM w),
qword AS (SELECT sli_id, split_part(entry_point, ':', 1) AS service_name,
  unnest(regexp_extract_all(lower(CASE WHEN contains(name, 'error') THEN 'errors' ELSE kind END || ' issues in ' || name || ' endpoint ' || entry_point || ' user journey flow'), '[a-z_]+')) AS w FROM cand),
qtf AS (SELECT sli_id, service_name, CAST(('0x' || substr(md5(w), 1, 6)) AS BIGINT) % 384 AS slot, count(*) AS tf FROM qword GROUP BY ALL),
qw AS (SELECT sli_id, service_name, slot, tf * coalesce(idf, ln((SELECT count(*) FROM cc) + 1) + 1) AS w FROM qtf LEFT JOIN idf USING (slot)),
qe AS (SELECT sli_id, service_name, slot, w / sqrt(sum(w * w) OVER (PARTITION BY sli_id)) AS x FROM qw),
sc AS (SELECT q.sli_id, c.capsule_id, round(sum(e.x * q.x), 9) AS score FROM qe q JOIN cc c USING (service_name) JOIN emb e ON e.capsule_id = c.capsule_id AND e.slot = q.slot GROUP BY ALL),
hit AS (SELECT *, row_number() OVER (PARTITION BY sli_id ORDER BY score DESC, capsule_id) AS position FROM sc),
lk AS (SELECT sli_id, count(*) AS evidence, arg_min(capsule_id, position) AS top_capsule FROM hit WHERE position <= 10 AND score >= 0.1 GROUP BY sli_id),
points AS (SELECT sli_id, kind, """ + ", ".join(
    f"quantile_cont(value, {p!r}::DOUBLE) AS up_{name}, quantile_cont(value, {1 - p!r}::DOUBLE) AS down_{name}" for name, p, _ in OBJECTIVE_VARIANTS
) + """ FROM val GROUP BY sli_id, kind),
tail AS (""" + " UNION ALL ".join(
    f"SELECT sli_id, kind, '{name}' AS variant, {target} AS target, CASE WHEN kind = 'availability' THEN down_{name} ELSE up_{name} END AS threshold FROM points"
    for name, _, target in OBJECTIVE_VARIANTS
) + """),
test AS (SELECT tail.sli_id, variant, count(val.value) AS total_samples,
    count(*) FILTER (CASE WHEN tail.kind = 'availability' THEN value < threshold ELSE value > threshold END) AS breach_count
  FROM tail LEFT JOIN val ON val.sli_id = tail.sli_id AND step BETWEEN epoch(TIMESTAMP '2024-01-31' - INTERVAL 30 DAY) AND epoch(TIMESTAMP '2024-01-31') GROUP BY tail.sli_id, variant),
newest AS (SELECT sli_id, arg_max(value, step) AS value FROM val GROUP BY sli_id)"""


@query("analysis_job", f"""
WITH {_JOB} SELECT sli_id, variant, round(confidence_score, 6) AS confidence_score, round(newest.value, 6) AS value, round(threshold, 6) AS threshold_value,
  target AS target_percentage, breach_count, total_samples, coalesce(evidence, 0) AS evidence, top_capsule
FROM cand JOIN newest USING (sli_id) JOIN tail USING (sli_id) JOIN test USING (sli_id, variant) LEFT JOIN lk USING (sli_id)""")
def analysis_job(spark, d):
    _, caps = evidence_parts(spark, d)
    vectors = vc.embed_terms(caps, "capsule_id", "template").join(caps.select("capsule_id", "service_name"), "capsule_id")
    spans = materialize(adapters.event_spans(spark, d).drop("timestamp"), "spans")
    requests = materialize(adapters.event_requests(spark, d), "requests")
    done = an.analyse(spans, requests, caps, materialize(vectors, "vectors"), "2024-01-31", 30, DAY, _BOUNDS, k=10, min_similarity=0.1)
    newest = done.values.groupBy("sli_id").agg(F.max_by("value", "step").alias("value"))
    links = done.evidence.groupBy("sli_id").agg(F.count(F.lit(1)).alias("evidence"), F.min_by("capsule_id", "position").alias("top_capsule"))
    tested = done.tested.withColumnRenamed("series", "sli_id")
    out = done.indicators.select("sli_id", "confidence_score").join(newest, "sli_id").join(tested, "sli_id").join(links, "sli_id", "left")
    return out.select(
        "sli_id", "variant", r6("confidence_score").alias("confidence_score"), r6("value").alias("value"), r6("threshold_value").alias("threshold_value"),
        "target_percentage", "breach_count", "total_samples", F.coalesce("evidence", F.lit(0)).alias("evidence"), "top_capsule",
    )
