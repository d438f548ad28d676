"""Service graph, journeys, span order."""

from pyspark.sql import functions as F

from tidegauge.operators import journeys as jn
from tidegauge.operators import traces as tr
from tidegauge.plans.ctes import JOURNEYS, SPANS, TRACES
from tidegauge.plans.registry import joined, query, r6
from tidegauge.session import materialize
from tidegauge.sources import adapters


@query("service_dependencies", f"""
WITH {SPANS} SELECT p.service_name AS caller, c.service_name AS callee, count(*) AS calls
FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id
WHERE p.service_name <> c.service_name GROUP BY ALL""")
def service_dependencies(spark, d):
    return tr.dependency_edges(stored_spans(spark, d))


@query("leaf_spans", f"""
WITH {JOURNEYS} SELECT service_name, span_name, count(*) AS leaves FROM leaves GROUP BY ALL""")
def leaf_spans(spark, d):
    return tr.leaf_spans(adapters.spans(spark, d)).groupBy("service_name", "span_name").agg(F.count(F.lit(1)).alias("leaves"))


@query("trace_summary", f"""
WITH {TRACES} SELECT trace_id, entry_point, round(total_ms, 4) AS total_ms, round(root_ms, 4) AS root_ms, failed, n_spans FROM traces""")
def trace_summary(spark, d):
    return tr.trace_summary(adapters.spans(spark, d)).withColumns(
        {"total_ms": F.round("total_ms", 4), "root_ms": F.round("root_ms", 4)}
    )


@query("trace_summary_by_span_id", f"""
WITH {SPANS} SELECT arg_min(service_name || ':' || span_name, span_id) AS entry_point, count(*) AS n_spans, trace_id FROM spans GROUP BY trace_id""")
def trace_summary_by_span_id(spark, d):
    return tr.trace_summary(adapters.spans(spark, d), root="span_id").select("trace_id", "entry_point", "n_spans")


@query("step_statistics", f"""
WITH {JOURNEYS} SELECT entry_point, service_name, span_name, n, duration_p50, round(error_rate, 6) AS error_rate FROM steps""")
def step_statistics(spark, d):
    spans = stored_spans(spark, d)
    return tr.step_statistics(spans, tr.trace_summary(spans)).withColumn("error_rate", r6("error_rate"))


def stored_spans(spark, d):
    """The spans as a stored table; deriving them ranks every order's lines."""
    return materialize(adapters.spans(spark, d), "spans")


def found(spark, d):
    return tr.discover_journeys(stored_spans(spark, d))


@query("journeys", f"""
WITH {JOURNEYS} SELECT entry_point, exit_point, name, traffic_volume, round(avg_duration_ms, 4) AS avg_duration_ms, round(avg_root_ms, 4) AS avg_root_ms,
  round(error_rate, 6) AS error_rate, sample_trace_ids, n_steps, step_labels FROM journeys""")
def journeys(spark, d):
    return found(spark, d).select(
        "entry_point", "exit_point", "name", "traffic_volume", F.round("avg_duration_ms", 4).alias("avg_duration_ms"),
        F.round("avg_root_ms", 4).alias("avg_root_ms"), r6("error_rate").alias("error_rate"), joined("sample_trace_ids"),
        F.size("step_sequence").alias("n_steps"),
        F.array_join(F.transform("step_sequence", lambda s: F.concat_ws(":", s["service_name"], s["span_name"])), ",").alias("step_labels"),
    )


_RANKED = """entry_point, rank, traffic_volume, round(error_rate, 6) AS error_rate, round(latency_variance, 6) AS latency_variance,
  round(latency_p95, 4) AS latency_p95, round(confidence_score, 6) AS confidence_score, round(business_impact_score, 6) AS business_impact_score"""


def ranked(spark, d):
    return tr.rank_journeys(found(spark, d))


def shown(df):
    return df.select(
        "entry_point", "rank", "traffic_volume", r6("error_rate").alias("error_rate"), r6("latency_variance").alias("latency_variance"),
        F.round("latency_p95", 4).alias("latency_p95"), r6("confidence_score").alias("confidence_score"),
        r6("business_impact_score").alias("business_impact_score"),
    )


@query("journey_ranking", f"WITH {JOURNEYS} SELECT {_RANKED} FROM ranked")
def journey_ranking(spark, d):
    return shown(ranked(spark, d))


@query("top_journeys", f"WITH {JOURNEYS} SELECT {_RANKED} FROM ranked WHERE confidence_score >= 60 ORDER BY rank LIMIT 5")
def top_journeys(spark, d):
    return shown(tr.top_journeys(ranked(spark, d), 5, 60.0))


@query("confident_journeys", f"WITH {JOURNEYS} SELECT entry_point, round(confidence_score, 6) AS confidence_score FROM ranked WHERE confidence_score >= 50")
def confident_journeys(spark, d):
    return tr.confident_journeys(ranked(spark, d)).select("entry_point", r6("confidence_score").alias("confidence_score"))


@query("trace_duration_p95", f"""
WITH {TRACES} SELECT entry_point, count(*) AS n, round(quantile_cont(total_ms, 0.95), 4) AS true_p95, round(avg(total_ms) * 1.5, 4) AS estimated_p95
FROM traces GROUP BY entry_point""")
def trace_duration_p95(spark, d):
    out = tr.duration_percentiles(adapters.spans(spark, d))
    return out.select("entry_point", "n", F.round("true_p95", 4).alias("true_p95"), F.round("estimated_p95", 4).alias("estimated_p95"))


@query("breadth_first_order", f"""
WITH RECURSIVE {SPANS}, walk AS (
  SELECT trace_id, span_id, 0 AS depth, [span_id] AS path FROM spans WHERE parent_span_id IS NULL
  UNION ALL
  SELECT s.trace_id, s.span_id, w.depth + 1, list_append(w.path, s.span_id) FROM spans s JOIN walk w ON s.trace_id = w.trace_id AND s.parent_span_id = w.span_id)
SELECT trace_id, span_id, depth, row_number() OVER (PARTITION BY trace_id ORDER BY depth, path) AS position FROM walk""")
def breadth_first_order(spark, d):
    return tr.breadth_first_order(stored_spans(spark, d))


def stored_journeys(spark, d):
    """What an earlier run knew."""
    return adapters.journeys(spark, d).select(
        "service_id", "name", "entry_point", "exit_point", "traffic_volume_per_day",
        F.lit(80.0).alias("confidence_score"), F.array(F.lit("old")).alias("sample_trace_ids"), "discovered_at", "last_seen_at",
    )


@query("journey_merge", """
WITH j AS (SELECT 'part-' || l_partkey AS name, min(l_suppkey) AS service_id, count(*) AS traffic, min(l_shipdate) AS first, max(l_shipdate) AS last, l_partkey FROM lineitem GROUP BY l_partkey)
SELECT service_id, name, CASE WHEN last < '2001-09-07' THEN traffic ELSE traffic * 2 END AS traffic_volume_per_day,
  CASE WHEN last < '2001-09-07' THEN 80.0 ELSE 90.0 END AS confidence_score, CASE WHEN last < '2001-09-07' THEN 'old' ELSE 'new' END AS sample_trace_ids,
  strftime(first, '%Y-%m-%d') AS discovered_at, strftime(CASE WHEN last < '2001-09-07' THEN last ELSE TIMESTAMP '2030-01-01' END, '%Y-%m-%d') AS last_seen_at FROM j
UNION ALL SELECT service_id, name || '-next', traffic * 2, 90.0, 'new', '2030-01-01', '2030-01-01' FROM j WHERE last < '2001-09-07'""")
def journey_merge(spark, d):
    """The fresh run finds the journeys still seen late, and a successor of every other one."""
    late = F.when(F.col("last_seen_at") >= "2001-09-07", F.col("name")).otherwise(F.concat("name", F.lit("-next")))
    fresh = adapters.journeys(spark, d).select(
        "service_id", late.alias("name"), "entry_point", "exit_point", (F.col("traffic_volume_per_day") * 2).alias("traffic_volume_per_day"),
        F.lit(90.0).alias("confidence_score"), F.array(F.lit("new")).alias("sample_trace_ids"),
    )
    merged = jn.merge_journeys(stored_journeys(spark, d), fresh, "2030-01-01")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return merged.select(
        "service_id", "name", "traffic_volume_per_day", "confidence_score", joined("sample_trace_ids"), day("discovered_at"), day("last_seen_at")
    )


@query("stale_journeys", """
WITH j AS (SELECT 'part-' || l_partkey AS name, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY l_partkey)
SELECT name, CASE WHEN last < TIMESTAMP '2001-12-01' - INTERVAL 7 DAY THEN 40.0 ELSE 80.0 END AS confidence_score FROM j""")
def stale_journeys(spark, d):
    once = jn.decay_stale(stored_journeys(spark, d), "2001-12-01")
    # a second run on the same date changes nothing
    return jn.decay_stale(once, "2001-12-01").select("name", "confidence_score")
