"""Similarity search, embeddings, evidence, context."""

from pyspark.sql import functions as F

from tidegauge.functions import naming
from tidegauge.operators import capsules as cp
from tidegauge.operators import evidence as ev
from tidegauge.operators import index as ix
from tidegauge.operators import vectors as vc
from tidegauge.plans.ctes import CAPSULES, CATALOG, FP, HITS, VEC, redact_sql
from tidegauge.plans.registry import query, r6, stamp
from tidegauge.session import materialize, workspace
from tidegauge.sources import adapters, stores


@query("similar_capsules", f"""
WITH {HITS} SELECT capsule_id, service_name, severity, strftime(time_bucket, '%Y-%m-%d %H:%M:%S') AS time_bucket, round(score, 6) AS score FROM (
  SELECT * FROM pairs WHERE query_id = 'svc-3' AND environment = 'prod' AND time_bucket BETWEEN TIMESTAMP '2024-06-01' - INTERVAL 365 DAY AND TIMESTAMP '2024-06-01'
  ORDER BY score DESC, capsule_id LIMIT 10) WHERE score >= 0.1""")
def similar_capsules(spark, d):
    one = adapters.query_vectors(spark, d).filter("query_id = 'svc-3'").first()["vector"]
    corpus = vc.collection_filter(adapters.vectors(spark, d), environment="prod", as_of="2024-06-01", time_range_days=365)
    hits = vc.search(corpus, one, 10, 0.1)
    return hits.select("capsule_id", "service_name", "severity", stamp("time_bucket"), r6("score").alias("score"))


@query("batch_similarity", f"""
WITH {HITS} SELECT query_id, capsule_id, round(score, 6) AS score, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, capsule_id) AS position FROM pairs) WHERE position <= 10""")
def batch_similarity(spark, d):
    return vc.batch_search(adapters.vectors(spark, d), adapters.query_vectors(spark, d), 10).withColumn("score", r6("score"))


@query("batch_similarity_in_service", f"""
WITH {HITS} SELECT query_id, capsule_id, round(score, 6) AS score, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, capsule_id) AS position FROM pairs WHERE service_name = query_service) WHERE position <= 10 AND score >= 0.2""")
def batch_similarity_in_service(spark, d):
    hits = vc.batch_search(adapters.vectors(spark, d), adapters.query_vectors(spark, d), 10, same=("service_name",))
    return vc.above_floor(hits, 0.2).withColumn("score", r6("score"))


def central(spark, d):
    """The capsule nearest to each service's mean direction."""
    return vc.batch_search(adapters.vectors(spark, d), adapters.query_vectors(spark, d), 1).select("capsule_id").distinct()


@query("related_capsules", f"""
WITH {HITS}, central AS (SELECT DISTINCT capsule_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, capsule_id) AS p FROM pairs) WHERE p = 1),
near AS (SELECT a.capsule_id AS query_id, b.capsule_id, round(list_inner_product(a.vector, b.vector), 9) AS score
  FROM vec a JOIN central USING (capsule_id) JOIN vec b ON a.capsule_id <> b.capsule_id)
SELECT query_id, capsule_id, round(score, 6) AS score, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, capsule_id) AS position FROM near) WHERE position <= 5""")
def related_capsules(spark, d):
    return vc.related_capsules(adapters.vectors(spark, d), central(spark, d), 5).withColumn("score", r6("score"))


def _bits(vector: str) -> str:
    side = lambda j, q: f"list_sum([v FOR v, i IN {vector} IF (i - 1) % 32 = {j + q * 8}])"
    return " + ".join(
        f"CASE WHEN {side(j, 0)} + {side(j, 1)} > {side(j, 2)} + {side(j, 3)} THEN {1 << j} ELSE 0 END" for j in range(8)
    )


@query("vector_sketches", f"WITH {VEC} SELECT sketch, count(*) AS vectors FROM (SELECT {_bits('vector')} AS sketch FROM vec) GROUP BY sketch")
def vector_sketches(spark, d):
    s = adapters.vectors(spark, d).select(vc.sketch(F.col("vector")).alias("sketch"))
    return s.groupBy("sketch").agg(F.count(F.lit(1)).alias("vectors"))


_APPROX = HITS + f""",
vs AS (SELECT capsule_id, {_bits('vector')} AS sketch FROM vec), qs AS (SELECT query_id, {_bits('vector')} AS sketch FROM qv),
near AS (SELECT query_id, capsule_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, capsule_id) AS position
  FROM pairs JOIN vs USING (capsule_id) JOIN qs USING (query_id) WHERE bit_count(xor(vs.sketch, qs.sketch)) <= 2),
truth AS (SELECT query_id, capsule_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, capsule_id) AS position FROM pairs)"""


@query("approximate_similarity", f"WITH {_APPROX} SELECT query_id, capsule_id, round(score, 6) AS score, position FROM near WHERE position <= 10")
def approximate_similarity(spark, d):
    return vc.approximate_search(adapters.vectors(spark, d), adapters.query_vectors(spark, d), 10, 2).withColumn("score", r6("score"))


@query("approximate_recall", f"""
WITH {_APPROX} SELECT t.query_id, count(*) AS expected, count(n.capsule_id) AS found, round(count(n.capsule_id) / count(*), 6) AS recall
FROM (SELECT * FROM truth WHERE position <= 10) t LEFT JOIN (SELECT * FROM near WHERE position <= 10) n USING (query_id, capsule_id) GROUP BY t.query_id""")
def approximate_recall(spark, d):
    v, q = adapters.vectors(spark, d), adapters.query_vectors(spark, d)
    return vc.recall(vc.approximate_search(v, q, 10, 2), vc.batch_search(v, q, 10)).withColumn("recall", r6("recall"))


def _index_sql(rounds: int = ix.ROUNDS) -> str:
    """The index in SQL: centres after every round, cells, and the number of probes."""
    steps = [f"""
smp AS (SELECT row_number() OVER (ORDER BY md5(capsule_id), capsule_id) - 1 AS r, capsule_id, vector FROM vec),
size AS (SELECT least({ix.MOST_CELLS}, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS cells FROM vec),
c0 AS (SELECT r AS cell, vector AS centre FROM smp, size WHERE r < cells)"""]
    nearest = "arg_min(cell, cell) FILTER (score = top)"
    for i in range(rounds):
        steps.append(f"""
a{i} AS (SELECT r, {nearest} AS cell FROM (SELECT *, max(score) OVER (PARTITION BY r) AS top FROM (
  SELECT r, cell, round(list_inner_product(vector, centre), 9) AS score FROM smp CROSS JOIN c{i} WHERE r < {ix.SAMPLE})) GROUP BY r),
m{i} AS (SELECT cell, pos, avg(x) AS x FROM (SELECT cell, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM a{i} JOIN smp USING (r)) GROUP BY cell, pos),
n{i} AS (SELECT cell, list(round(x / norm, 9) ORDER BY pos) AS centre FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY cell)) AS norm FROM m{i}) GROUP BY cell),
c{i + 1} AS (SELECT cell, coalesce(n{i}.centre, c{i}.centre) AS centre FROM c{i} LEFT JOIN n{i} USING (cell))""")
    return ",".join(steps) + f""",
cells AS (SELECT capsule_id, {nearest} AS cell FROM (SELECT *, max(score) OVER (PARTITION BY capsule_id) AS top FROM (
  SELECT capsule_id, cell, round(list_inner_product(vector, centre), 9) AS score FROM smp CROSS JOIN c{rounds})) GROUP BY capsule_id),
trial AS (SELECT capsule_id AS query_id, vector FROM smp WHERE r < {ix.TRIALS}),
tt AS (SELECT query_id, v.capsule_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(v.vector, t.vector), 9) DESC, v.capsule_id) AS p
  FROM trial t JOIN vec v ON v.capsule_id <> t.query_id),
places AS (SELECT query_id, cell, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(vector, centre), 9) DESC, cell) AS place FROM (
  SELECT query_id, vector FROM trial UNION ALL SELECT query_id, vector FROM qv) CROSS JOIN c{rounds}),
ranks AS (SELECT place, row_number() OVER (ORDER BY place) AS i, count(*) OVER () AS n FROM tt JOIN cells USING (capsule_id) JOIN places USING (query_id, cell) WHERE p <= 10),
probes AS (SELECT min(place) AS probes FROM ranks WHERE i = CAST(ceil(n * {ix.TARGET}) AS BIGINT)),
near AS (SELECT query_id, capsule_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, capsule_id) AS position
  FROM pairs JOIN cells USING (capsule_id) JOIN places USING (query_id, cell), probes WHERE place <= probes),
truth AS (SELECT query_id, capsule_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, capsule_id) AS position FROM pairs)"""


def fitted(spark, d):
    return ix.fit_index(adapters.vectors(spark, d), workspace(spark, "vector-index"))


@query("indexed_similarity", f"WITH {HITS},{_index_sql()} SELECT query_id, capsule_id, round(score, 6) AS score, position FROM near WHERE position <= 10")
def indexed_similarity(spark, d):
    return ix.search_index(spark, fitted(spark, d), adapters.query_vectors(spark, d), 10).withColumn("score", r6("score"))


@query("indexed_recall", f"""
WITH {HITS},{_index_sql()}, sizes AS (SELECT cell, count(*) AS n FROM cells GROUP BY cell),
scored AS (SELECT query_id, sum(n) AS scored FROM places JOIN sizes USING (cell), probes WHERE place <= probes GROUP BY query_id)
SELECT t.query_id, count(*) AS expected, count(n.capsule_id) AS found, round(count(n.capsule_id) / count(*), 6) AS recall, any_value(probes) AS probes,
  round(any_value(scored) / (SELECT count(*) FROM vec), 6) AS scored_share
FROM (SELECT * FROM truth WHERE position <= 10) t LEFT JOIN (SELECT * FROM near WHERE position <= 10) n USING (query_id, capsule_id)
JOIN scored ON scored.query_id = t.query_id, probes GROUP BY t.query_id""")
def indexed_recall(spark, d):
    index, asked = fitted(spark, d), adapters.query_vectors(spark, d)
    exact = vc.batch_search(adapters.vectors(spark, d), asked, 10)
    out = vc.recall(ix.search_index(spark, index, asked, 10), exact).join(ix.pairs_scored(spark, index, asked), "query_id")
    return out.select("query_id", "expected", "found", r6("recall").alias("recall"), F.lit(index.probes).cast("bigint").alias("probes"),
                      r6(F.col("scored") / F.col("stored")).alias("scored_share"))


# --- embeddings of templates --------------------------------------------------------

_EMB = FP + """,
tpl AS (SELECT DISTINCT fingerprint_hash, template FROM fp),
word AS (SELECT fingerprint_hash, unnest(regexp_extract_all(lower(template), '[a-z_]+')) AS w FROM tpl),
tf AS (SELECT fingerprint_hash, CAST(('0x' || substr(md5(w), 1, 6)) AS BIGINT) % 384 AS slot, count(*) AS tf FROM word GROUP BY ALL),
idf AS (SELECT slot, ln(((SELECT count(*) FROM tpl) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY slot),
w AS (SELECT fingerprint_hash, slot, tf * idf AS w FROM tf JOIN idf USING (slot)),
emb AS (SELECT fingerprint_hash, slot, w / sqrt(sum(w * w) OVER (PARTITION BY fingerprint_hash)) AS x FROM w)"""


def templates(spark, d):
    rows = cp.hourly_templates(adapters.telemetry(spark, d)).select("template").distinct()
    # read several times by the embedding
    return materialize(rows.select(F.sha2("template", 256).alias("fingerprint_hash"), "template"), "templates")


@query("template_embeddings", f"WITH {_EMB} SELECT fingerprint_hash, slot, round(x, 6) AS x FROM emb")
def template_embeddings(spark, d):
    e = vc.embed_terms(templates(spark, d), "fingerprint_hash", "template")
    return e.select("fingerprint_hash", F.posexplode("vector").alias("slot", "x")).filter("x <> 0").withColumn("x", r6("x"))


_SEARCH_TEXT = "request failed for user token rejected"


@query("template_search", f"""
WITH {_EMB}, qt AS (SELECT CAST(('0x' || substr(md5(w), 1, 6)) AS BIGINT) % 384 AS slot, count(*) AS tf FROM (SELECT unnest(string_split('{_SEARCH_TEXT}', ' ')) AS w) GROUP BY slot),
qw AS (SELECT slot, tf * coalesce(idf, ln((SELECT count(*) FROM tpl) + 1) + 1) AS w FROM qt LEFT JOIN idf USING (slot)),
qe AS (SELECT slot, w / sqrt(sum(w * w) OVER ()) AS x FROM qw),
sc AS (SELECT fingerprint_hash, round(sum(emb.x * qe.x), 9) AS score FROM emb JOIN qe USING (slot) GROUP BY fingerprint_hash)
SELECT fingerprint_hash AS capsule_id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, fingerprint_hash LIMIT 20""")
def template_search(spark, d):
    text = spark.createDataFrame([("q", _SEARCH_TEXT)], "query_id string, template string")
    return vc.search_texts(templates(spark, d), text, "fingerprint_hash", "template", 20).select("capsule_id", r6("score").alias("score"))


# --- evidence -------------------------------------------------------------------------

_JOURNEY_TEXT = "checkout request failed payment account"


def evidence_parts(spark, d):
    """Indicators of every service (five each) and the capsules they may cite."""
    rows = cp.hourly_templates(adapters.telemetry(spark, d)).select(
        "template", "service_name", "redaction_checked", "event_id", "attributes"
    )
    # counts and samples read the rows; the pattern rules are run once
    rows = materialize(rows, "templates")
    caps = rows.groupBy("template", "service_name").agg(
        F.count(F.lit(1)).alias("count"), F.bool_and("redaction_checked").alias("redaction_applied")
    )
    sampled = rows.select("template", "service_name", "event_id", "attributes")
    picked = cp.bottom_k(sampled, ["template", "service_name"], "event_id")
    samples = picked.groupBy("template", "service_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("sample_rank", F.map_entries("attributes").alias("a")))),
                    lambda s: F.map_from_entries(s["a"])).alias("sample_array")
    )
    caps = caps.join(samples, ["template", "service_name"]).withColumn(
        "capsule_id", F.md5(F.concat_ws("|", F.sha2("template", 256), "service_name"))
    )
    caps = materialize(caps, "capsules")
    services = adapters.telemetry(spark, d).groupBy("service_name").agg(F.max("trace_id").alias("t"))
    base = services.select("service_name", F.lit(_JOURNEY_TEXT).alias("name"), F.lit("/api/checkout").alias("entry_point"),
                           F.array("t").alias("sample_trace_ids"))
    ind = ev.indicator_candidates(base, F.col("service_name")).select(
        F.concat_ws("|", "service_name", F.element_at(F.split("sli_name", " "), -1)).alias("sli_id"),
        "service_name", "sli_name", F.col("name").alias("journey_name"), "entry_point", "sample_trace_ids",
    )
    return ind, caps


def links(spark, d):
    ind, caps = evidence_parts(spark, d)
    vectors = vc.embed_terms(caps, "capsule_id", "template").join(caps.select("capsule_id", "service_name"), "capsule_id")
    vectors = materialize(vectors, "vectors")
    return ev.link_evidence(ind, caps, vectors, 10, 0.1), ind, caps


_LINKS = FP + f""",
cc AS (SELECT template, service_name, md5(sha256(template) || '|' || service_name) AS capsule_id, count(*) AS count, TRUE AS redacted_any FROM fp GROUP BY ALL),
smp AS (SELECT template, service_name, {redact_sql('message', strict=True)} AS message, trace_id, kind, value, row_number() OVER (PARTITION BY template, service_name ORDER BY h, event_id) AS rk FROM fp),
strace AS (SELECT template, service_name, rk, message, CASE WHEN kind = 'error' OR (kind = 'click' AND value >= 10) THEN trace_id END AS t FROM smp WHERE rk <= 10),
jt AS (SELECT service_name, max(trace_id) AS jt FROM fp GROUP BY service_name),
ct AS (SELECT template, service_name, coalesce(arg_min(t, rk) FILTER (t = jt), arg_min(t, rk) FILTER (t IS NOT NULL)) AS trace_id, arg_min(message, rk) AS log_sample
  FROM strace JOIN jt USING (service_name) GROUP BY ALL),
word AS (SELECT capsule_id, unnest(regexp_extract_all(lower(template), '[a-z_]+')) AS w FROM cc),
tf AS (SELECT capsule_id, CAST(('0x' || substr(md5(w), 1, 6)) AS BIGINT) % 384 AS slot, count(*) AS tf FROM word GROUP BY ALL),
idf AS (SELECT slot, ln(((SELECT count(*) FROM cc) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY slot),
w AS (SELECT capsule_id, slot, tf * idf AS w FROM tf JOIN idf USING (slot)),
emb AS (SELECT capsule_id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY capsule_id)) AS x FROM w),
sli AS (SELECT service_name, service_name || '|' || suffix AS sli_id, kind || ' issues in {_JOURNEY_TEXT} endpoint /api/checkout user journey flow' AS txt
  FROM (SELECT DISTINCT service_name FROM fp) CROSS JOIN (VALUES ('account-latency-p50', 'latency'), ('account-latency-p95', 'latency'), ('account-latency-p99', 'latency'),
    ('account-error-rate', 'errors'), ('account-availability', 'availability')) AS v(suffix, kind)),
qword AS (SELECT sli_id, service_name, unnest(regexp_extract_all(lower(txt), '[a-z_]+')) AS w FROM sli),
qtf AS (SELECT sli_id, service_name, CAST(('0x' || substr(md5(w), 1, 6)) AS BIGINT) % 384 AS slot, count(*) AS tf FROM qword GROUP BY ALL),
qw AS (SELECT sli_id, service_name, slot, tf * coalesce(idf, ln((SELECT count(*) FROM cc) + 1) + 1) AS w FROM qtf LEFT JOIN idf USING (slot)),
qe AS (SELECT sli_id, service_name, slot, w / sqrt(sum(w * w) OVER (PARTITION BY sli_id)) AS x FROM qw),
sc AS (SELECT q.sli_id, c.capsule_id, round(sum(e.x * q.x), 9) AS score FROM qe q JOIN cc c USING (service_name) JOIN emb e ON e.capsule_id = c.capsule_id AND e.slot = q.slot GROUP BY ALL),
hit AS (SELECT *, row_number() OVER (PARTITION BY sli_id ORDER BY score DESC, capsule_id) AS position FROM sc),
lk AS (SELECT sli_id, hit.capsule_id, cc.service_name, score, position, cc.template, cc.count, ct.trace_id,
  CASE WHEN redacted_any THEN ct.log_sample END AS log_sample, CASE WHEN redacted_any THEN 'redacted' ELSE 'pending' END AS redaction_status,
  score / sum(score) OVER (PARTITION BY sli_id) * 100 AS contribution
  FROM hit JOIN cc USING (capsule_id) JOIN ct ON ct.template = cc.template AND ct.service_name = cc.service_name WHERE position <= 10 AND score >= 0.1)"""


@query("evidence_links", f"""
WITH {_LINKS} SELECT sli_id, capsule_id, service_name, round(score, 6) AS score, position, template, count, trace_id, log_sample, redaction_status,
  round(contribution, 6) AS confidence_contribution FROM lk""")
def evidence_links(spark, d):
    return links(spark, d)[0].withColumns({"score": r6("score"), "confidence_contribution": r6("confidence_contribution")})


@query("stored_evidence", f"""
WITH {_LINKS} SELECT sli_id, capsule_id, trace_id, log_sample, redaction_status, round(contribution, 6) AS confidence_contribution FROM lk""")
def stored_evidence(spark, d):
    """Evidence pointers as a later run reads them, stored twice as by a run that was repeated."""
    path = workspace(spark, "evidence")
    found = materialize(links(spark, d)[0], "links")
    for _ in range(2):
        ev.store_evidence(path, found, "2024-06-01")
    return stores.read_table(spark, path).select(
        "sli_id", "capsule_id", "trace_id", "log_sample", "redaction_status", r6("confidence_contribution").alias("confidence_contribution")
    )


@query("evidence_summary", f"""
WITH {_LINKS} SELECT sli_id, count(*) AS total_evidence_count, round(avg(score), 6) AS avg_similarity, arg_min(capsule_id, position) AS top_capsule_id,
  round(max(score), 6) AS top_similarity, count(*) FILTER (redaction_status = 'redacted') AS redacted_count FROM lk GROUP BY sli_id""")
def evidence_summary(spark, d):
    return ev.evidence_summary(links(spark, d)[0]).withColumns({"avg_similarity": r6("avg_similarity"), "top_similarity": r6("top_similarity")})


@query("indicators_with_evidence", f"""
WITH {_LINKS}, r AS (SELECT sli_id, string_agg(capsule_id, ',' ORDER BY contribution DESC, capsule_id) AS capsules, count(*) AS n FROM lk GROUP BY sli_id)
SELECT sli.sli_id, coalesce(n, 0) AS n, coalesce(capsules, '') AS capsules FROM sli LEFT JOIN r USING (sli_id)""")
def indicators_with_evidence(spark, d):
    found, ind, _ = links(spark, d)
    out = ev.indicators_with_evidence(ind, found)
    return out.select(
        "sli_id", F.size("evidence_pointers").cast("bigint").alias("n"),
        F.array_join(F.transform("evidence_pointers", lambda e: e["capsule_id"]), ",").alias("capsules"),
    )


@query("context_rows", f"""
WITH {_LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY sli_id ORDER BY count DESC, capsule_id) AS rr FROM lk)
SELECT sli_id AS query_id, CAST(sum(count) AS BIGINT) AS total_events, count(DISTINCT template) AS unique_templates, count(*) AS capsule_count,
  string_agg(template || '=' || count, '; ' ORDER BY rr) FILTER (rr <= 5) AS top_templates, string_agg(capsule_id, ',' ORDER BY position) AS pointers,
  round(sum(least(100, least(100, log10(greatest(1, count)) * 25) * CASE WHEN redaction_status = 'redacted' THEN 1.1 ELSE 1 END)), 6) AS contribution_sum
FROM r GROUP BY sli_id""")
def context_rows(spark, d):
    found, _, caps = links(spark, d)
    out = ev.context_rows(found.withColumnRenamed("sli_id", "query_id"), caps)
    return out.select(
        "query_id", "total_events", "unique_templates", "capsule_count",
        F.array_join(F.transform("top_templates", lambda t: F.concat_ws("=", t["template"], t["count"].cast("string"))), "; ").alias("top_templates"),
        F.array_join(F.transform("evidence_pointers", lambda e: e["capsule_id"]), ",").alias("pointers"),
        r6(F.aggregate("evidence_pointers", F.lit(0.0), lambda a, e: a + e["confidence_contribution"])).alias("contribution_sum"),
    )


_CAND = CATALOG + """,
cand AS (SELECT j.*, s.name AS service, s.name || '|' || j.name AS k FROM catj j JOIN services s USING (service_id)),
rows AS (
  SELECT name, service, name || '-latency-p' || p AS sli_name, 'latency' AS metric_type, 'ms' AS unit,
    'histogram_quantile(' || (p / 100.0) || ', sum by (le) (rate(http_request_duration_seconds_bucket{job="' || service || '", endpoint="' || entry_point || '"}[5m]))) * 1000' AS metric_definition
  FROM cand CROSS JOIN (VALUES (50), (95), (99)) AS v(p)
  UNION ALL SELECT name, service, name || s, t, '%', '(sum(rate(http_requests_total{job="' || service || '", endpoint="' || entry_point || '", status_code' || m
    || '"5.."}[5m])) / sum(rate(http_requests_total{job="' || service || '", endpoint="' || entry_point || '"}[5m]))) * 100'
  FROM cand CROSS JOIN (VALUES ('-error-rate', 'error_rate', '=~'), ('-availability', 'availability', '!~')) AS v(s, t, m))"""


@query("indicator_candidates", f"""
WITH {_CAND} SELECT sli_name, metric_type, unit, replace(metric_definition, '(0.50,', '(0.5,') AS metric_definition,
  replace(service, '-', '_') || ':' || replace(sli_name, '-', '_') || ':recording' AS rule_name FROM rows""")
def indicator_candidates(spark, d):
    s = adapters.services(spark, d).select("service_id", F.col("name").alias("service"))
    j = adapters.journeys(spark, d).join(s, "service_id")
    return ev.indicator_candidates(j, F.col("service")).select(
        "sli_name", "metric_type", "unit", "metric_definition",
        naming.recording_rule_name(F.col("service"), F.col("sli_name")).alias("rule_name"),
    )


@query("rule_names", f"""
WITH {CATALOG}
SELECT j.name AS journey, 'Svc' || j.service_id || 'Part' || j.journey_id || 'LatencyP95Critical' AS alert_name, 'api' AS first_segment,
  'latency issues in ' || j.name || ' endpoint ' || entry_point || ' user journey flow' AS query_text
FROM catj j JOIN services s USING (service_id)""")
def rule_names(spark, d):
    s = adapters.services(spark, d).select("service_id", F.col("name").alias("service"))
    j = adapters.journeys(spark, d).join(s, "service_id")
    sli = F.concat(F.col("name"), F.lit("-latency_p95"))
    return j.select(
        F.col("name").alias("journey"), naming.alert_name(F.col("service"), sli, F.lit("CRITICAL")).alias("alert_name"),
        naming.service_of_entry(F.col("entry_point")).alias("first_segment"),
        naming.evidence_query(sli, F.col("name"), F.col("entry_point")).alias("query_text"),
    )


@query("indicator_updates", """
SELECT p_partkey AS sli_id, CASE WHEN p_size < 20 THEN 'system' WHEN p_size > 30 THEN 'none' ELSE 'lead' END AS approved_by,
  CASE WHEN p_size < 20 THEN '2024-02-01' ELSE 'none' END AS approved_at, CASE WHEN p_size > 40 THEN 'changed' ELSE p_name END AS metric_definition FROM part""")
def indicator_updates(spark, d):
    from tidegauge.sources.tables import table

    part = table(spark, d, "part")
    stored = part.select(
        F.col("p_partkey").alias("sli_id"), F.lit("lead").alias("approved_by"), F.lit(None).cast("timestamp").alias("approved_at"),
        F.col("p_name").alias("metric_definition"),
    )
    changes = part.filter("p_size < 20 or p_size > 30").select(
        F.col("p_partkey").alias("sli_id"), (F.col("p_size") < 20).alias("approved"),
        F.when(F.col("p_size") > 40, "changed").alias("metric_definition_override"),
    )
    out = ev.update_indicators(stored, changes, "2024-02-01")
    return out.select(
        "sli_id", F.coalesce("approved_by", F.lit("none")).alias("approved_by"),
        F.coalesce(F.date_format("approved_at", "yyyy-MM-dd"), F.lit("none")).alias("approved_at"), "metric_definition",
    )


@query("inline_or_file_samples", f"""
WITH {CAPSULES}, f AS (SELECT capsule_id, sample_event_ids, count FROM cap)
SELECT capsule_id, sample_event_ids, CASE WHEN count > 1 THEN 'inline' ELSE 'file' END AS source FROM f""")
def inline_or_file_samples(spark, d):
    caps = cp.build_capsules(adapters.telemetry(spark, d)).withColumn("capsule_id", cp.capsule_id())
    as_map = F.transform("sample_event_ids", lambda i: F.create_map(F.lit("event_id"), i))
    files = caps.filter("count = 1").select("capsule_id", as_map.alias("sample_array"))
    stored = caps.select(
        "capsule_id", "count", F.when(F.col("count") > 1, as_map).otherwise(F.array().cast("array<map<string,string>>")).alias("sample_array")
    )
    out = ev.hydrate(caps.select("capsule_id"), stored, files)
    return out.select(
        "capsule_id", F.array_join(F.transform("sample_array", lambda s: s["event_id"]), ",").alias("sample_event_ids"),
        F.when(F.col("count") > 1, "inline").otherwise("file").alias("source"),
    )
