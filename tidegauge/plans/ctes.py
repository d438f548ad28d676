"""SQL building blocks of the oracles, written against the supplied tables."""

from tidegauge.constants import MASK_PATTERNS, REDACTION_PATTERNS, STRICT_TOKEN_PATTERN


def redact_sql(expr: str, strict: bool = False) -> str:
    for kind, pattern, replacement in REDACTION_PATTERNS:
        if strict and kind == "token":
            pattern = STRICT_TOKEN_PATTERN
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"
    return expr


def mask_sql(expr: str) -> str:
    for _, pattern, replacement in MASK_PATTERNS:
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"
    return expr


TEL = """
tel AS (
  SELECT event_id AS eid, CAST(event_id AS VARCHAR) AS event_id, event_type AS kind, value, ts, user_id,
    'svc-' || (user_id % 8) AS service_name,
    CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS environment,
    CASE event_type WHEN 'view' THEN 'trace' WHEN 'click' THEN 'metric' ELSE 'log' END AS event_type,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS severity,
    user_id || '-' || strftime(ts, '%Y%m%d%H') AS trace_id,
    CASE event_type
      WHEN 'view' THEN 'user_id=' || user_id || ' viewed item ' || event_id || ' from 10.' || (user_id % 250) || '.' || (event_id % 250) || '.' || (CAST(floor(value) AS BIGINT) % 250)
      WHEN 'click' THEN 'uid: ' || user_id || ' clicked banner ' || (event_id % 5) || ' at ' || strftime(ts, '%Y-%m-%d %H:%M:%S')
      WHEN 'purchase' THEN 'payment of ' || CAST(floor(value) AS BIGINT) || ' USD by user' || user_id || '@shop.example card 4111 1111 1111 ' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0')
      WHEN 'signup' THEN 'new account for user' || user_id || '@mail.example.org phone 1415555' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0')
      ELSE 'request ' || lpad(lower(to_hex(event_id)), 8, '0') || '-0000-4000-8000-000000000000 failed for user_id=' || user_id || ': Bearer tok.' || event_id || ' rejected after ' || CAST(floor(value) AS BIGINT) || ' ms'
    END AS message
  FROM events
)"""

FP = TEL + f""",
fp0 AS (SELECT *, {redact_sql('message')} AS redacted FROM tel),
fp1 AS (SELECT *, {mask_sql('redacted')} AS template FROM fp0),
fp AS (SELECT *, sha256(template) AS fingerprint_hash, date_trunc('hour', ts) AS time_bucket, md5(event_id) AS h FROM fp1)"""

CAPSULES = FP + """,
capsev AS (
  SELECT fingerprint_hash, service_name, time_bucket, severity, count(*) AS n,
    CASE severity WHEN 'INFO' THEN 2 WHEN 'WARN' THEN 3 ELSE 4 END AS sr
  FROM fp GROUP BY ALL),
capsum AS (
  SELECT fingerprint_hash, service_name, time_bucket, count(*) AS count, min(template) AS template,
    min(ts) AS first_seen_at, max(ts) AS last_seen_at, bool_or(message <> redacted) AS redaction_hit
  FROM fp GROUP BY ALL),
capdist AS (
  SELECT fingerprint_hash, service_name, time_bucket,
    string_agg(severity || '=' || n, ',' ORDER BY severity) AS severity_distribution,
    arg_max(severity, n * 10 + sr) AS severity
  FROM capsev GROUP BY ALL),
caprank AS (
  SELECT fingerprint_hash, service_name, time_bucket, event_id, eid, kind, trace_id, value, redacted, h,
    row_number() OVER (PARTITION BY fingerprint_hash, service_name, time_bucket ORDER BY h, event_id) AS rk
  FROM fp),
capsmp AS (
  SELECT fingerprint_hash, service_name, time_bucket, string_agg(event_id, ',' ORDER BY h, event_id) AS sample_event_ids
  FROM caprank WHERE rk <= 10 GROUP BY ALL),
cap AS (
  SELECT s.*, d.severity_distribution, d.severity, m.sample_event_ids,
    md5(s.fingerprint_hash || '|' || s.service_name || '|' || CAST(epoch(s.time_bucket) AS BIGINT)) AS capsule_id
  FROM capsum s JOIN capdist d USING (fingerprint_hash, service_name, time_bucket)
  JOIN capsmp m USING (fingerprint_hash, service_name, time_bucket))"""

REQ = """
req AS (
  SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec, 'svc-' || (user_id % 8) AS service,
    CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS environment,
    '/' || event_type AS endpoint,
    CASE WHEN event_type = 'error' AND value > 50 THEN 503 WHEN event_type = 'error' THEN 500
      WHEN event_type = 'signup' THEN 201 WHEN event_type = 'click' AND value < 5 THEN 404 ELSE 200 END AS status_code,
    value AS latency
  FROM events)"""

SPANS = """
lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    l_quantity, l_discount, l_tax, l_shipdate) AS n FROM lineitem),
spans AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, '000' AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id,
    'GET_/' || o_orderstatus AS span_name, 'edge-' || (o_custkey % 3) AS service_name, o_totalprice AS duration_ms, FALSE AS bad
  FROM orders
  UNION ALL
  SELECT CAST(l_orderkey AS VARCHAR), lpad(CAST(n AS VARCHAR), 3, '0'), lpad(CAST(n // 2 AS VARCHAR), 3, '0'),
    l_returnflag || '_' || l_linestatus, 'svc-' || (l_suppkey % 7), l_quantity, l_returnflag = 'R' AND l_quantity >= 45
  FROM lines)"""

TRACES = SPANS + """,
traces AS (
  SELECT trace_id,
    arg_min(service_name || ':' || span_name, CASE WHEN parent_span_id IS NULL THEN '0' ELSE '1' END || span_id) AS entry_point,
    sum(duration_ms) AS total_ms,
    arg_min(duration_ms, CASE WHEN parent_span_id IS NULL THEN '0' ELSE '1' END || span_id) AS root_ms,
    bool_or(bad) AS failed, count(*) AS n_spans
  FROM spans GROUP BY trace_id)"""

JOURNEYS = TRACES + """,
leaves AS (
  SELECT s.* FROM spans s WHERE NOT EXISTS (
    SELECT 1 FROM spans c WHERE c.trace_id = s.trace_id AND c.parent_span_id = s.span_id)),
exits AS (
  SELECT entry_point, service_name || ':' || span_name AS exit_point, count(*) AS n
  FROM leaves JOIN traces USING (trace_id) GROUP BY ALL),
exit1 AS (
  SELECT entry_point, exit_point FROM exits
  QUALIFY row_number() OVER (PARTITION BY entry_point ORDER BY n DESC, exit_point) = 1),
steps AS (
  SELECT entry_point, service_name, span_name, count(*) AS n,
    list_sort(list(duration_ms))[CAST(count(*) // 2 AS BIGINT) + 1] AS duration_p50,
    avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END) AS error_rate
  FROM spans JOIN traces USING (trace_id) GROUP BY ALL),
steps1 AS (
  SELECT entry_point, count(*) AS n_steps, stddev_pop(duration_p50) AS latency_variance,
    string_agg(service_name || ':' || span_name, ',' ORDER BY service_name || ':' || span_name) AS step_labels
  FROM steps GROUP BY entry_point),
smp AS (
  SELECT entry_point, string_agg(trace_id, ',' ORDER BY trace_id) AS sample_trace_ids, count(*) AS n_samples FROM (
    SELECT entry_point, trace_id FROM traces
    QUALIFY row_number() OVER (PARTITION BY entry_point ORDER BY trace_id) <= 10) GROUP BY entry_point),
tot AS (
  SELECT entry_point, count(*) AS traffic_volume, avg(total_ms) AS avg_duration_ms, avg(root_ms) AS avg_root_ms,
    avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END) AS error_rate
  FROM traces GROUP BY entry_point HAVING count(*) >= 10),
journeys AS (
  SELECT *, replace(replace(lower(split_part(entry_point, ':', -1) || '-to-' || split_part(exit_point, ':', -1)), '/', '-'), '_', '-') AS name
  FROM tot JOIN exit1 USING (entry_point) JOIN smp USING (entry_point) JOIN steps1 USING (entry_point)),
ranked0 AS (
  SELECT *, least(100, least(70, log10(greatest(1, traffic_volume)) * 10) + least(10, n_samples) + least(20, n_steps * 2)) AS confidence_score,
    avg_duration_ms * 1.5 AS latency_p95,
    (traffic_volume / (SELECT max(traffic_volume) FROM journeys) * 0.4 + error_rate * 0.3
      + latency_variance / (SELECT max(latency_variance) FROM journeys) * 0.3) * 100 AS business_impact_score
  FROM journeys),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY round(business_impact_score, 9) DESC, entry_point) AS rank FROM ranked0)"""

VEC = """
vec AS (
  SELECT CAST(vec_id AS VARCHAR) AS capsule_id, sha256(CAST(vec_id AS VARCHAR)) AS fingerprint_hash,
    'svc-' || label AS service_name,
    CASE vec_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS environment,
    CASE WHEN vec_id % 5 = 0 THEN 'ERROR' ELSE 'INFO' END AS severity,
    TIMESTAMP '2024-01-01' + to_hours(CAST(vec_id AS BIGINT)) AS time_bucket,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector
  FROM embeddings),
qcell AS (
  SELECT service_name, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM vec),
qmean AS (SELECT service_name, pos, avg(x) AS m FROM qcell GROUP BY ALL),
qnorm AS (SELECT service_name, list(m ORDER BY pos) AS m, sqrt(sum(m * m)) AS norm FROM qmean GROUP BY service_name),
qv AS (SELECT service_name AS query_id, service_name, list_transform(m, lambda x: x / norm) AS vector FROM qnorm)"""

HITS = VEC + """,
pairs AS (
  SELECT q.query_id, q.service_name AS query_service, v.*, round(list_inner_product(v.vector, q.vector), 9) AS score
  FROM vec v CROSS JOIN qv q)"""

CATALOG = """
services AS (
  SELECT s_suppkey AS service_id, 'svc-' || s_suppkey AS name,
    CASE s_suppkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS environment,
    'org-' || n_regionkey AS organization_id, CASE WHEN s_acctbal < 0 THEN 'paused' ELSE 'active' END AS status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
catj AS (
  SELECT l_partkey AS journey_id, min(l_suppkey) AS service_id, count(*) AS traffic_volume_per_day,
    count(DISTINCT l_returnflag || '_' || l_linestatus) AS n_endpoints,
    min(l_shipdate) AS discovered_at, max(l_shipdate) AS last_seen_at,
    'part-' || l_partkey AS name, '/api/part/' || l_partkey AS entry_point
  FROM lineitem GROUP BY l_partkey),
arts AS (
  SELECT p_partkey * 4 + i AS artifact_id, p_partkey AS slo_id, p_partkey, kind AS artifact_type, cost,
    CASE WHEN (p_partkey + i) % 5 = 0 THEN 'pending' ELSE 'approved' END AS approval_status
  FROM part CROSS JOIN (VALUES (0, 'prometheus_recording', 5.0), (1, 'prometheus_alert', 10.0),
    (2, 'grafana_dashboard', 2.0), (3, 'runbook', 1.0)) AS k(i, kind, cost)),
slos AS (SELECT p_partkey AS slo_id, p_partkey AS sli_id FROM part WHERE p_size < 50),
chain AS (
  SELECT a.*, o.sli_id, j.journey_id, j.service_id, j.traffic_volume_per_day, j.n_endpoints, s.organization_id
  FROM arts a LEFT JOIN slos o USING (slo_id)
  LEFT JOIN (SELECT *, journey_id AS k FROM catj) j ON o.sli_id = j.k
  LEFT JOIN services s USING (service_id)),
impact AS (
  SELECT artifact_id, artifact_type, service_id, organization_id, slo_id,
    1 AS affected_services_count,
    round(100.0 / (SELECT count(*) FROM services), 2) AS affected_services_percentage,
    greatest(1, n_endpoints) AS affected_endpoints_count,
    round(traffic_volume_per_day / (SELECT sum(traffic_volume_per_day) FROM catj JOIN services USING (service_id)) * 100, 2) AS affected_traffic_percentage,
    CAST(cost AS DOUBLE) AS estimated_cost_impact_usd
  FROM chain WHERE organization_id IS NOT NULL)"""
