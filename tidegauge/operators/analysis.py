"""Values of candidate indicators, and the analysis job from spans to tested objectives."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.constants import HISTOGRAM_BOUNDS
from tidegauge.functions.scoring import journey_confidence
from tidegauge.operators.evidence import indicator_candidates, link_evidence
from tidegauge.operators.metrics import backtest, objective_variants, step_start
from tidegauge.operators.traces import discover_journeys
from tidegauge.session import materialize

INFINITY = float("inf")


def request_series(requests: DataFrame, window: int = 300, bounds: list[float] | None = None) -> DataFrame:
    """Histogram and status counters of every ``job``, ``endpoint`` and window.

    ``requests``: job, endpoint, ts, seconds, status (text). One row per window holds the
    bounds (``le``, the last one open), their cumulative counts (``n``) and the requests of
    each status (``statuses``). Requests are counted per status first, before the shuffle.
    """
    bounds = sorted(bounds or HISTOGRAM_BOUNDS["http_request_seconds"])
    keys = ["job", "endpoint", step_start(F.col("ts"), window).cast("bigint").alias("step")]
    names = [f"_{i}" for i in range(len(bounds))]
    counted = requests.groupBy(*keys, "status").agg(
        F.count("seconds").alias("_n"), F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("seconds") <= b).alias(c) for c, b in zip(names, bounds)])
    return counted.groupBy("job", "endpoint", "step").agg(
        F.array(*[F.sum(c) for c in names], F.sum("_n")).alias("n"),
        # one entry per status
        F.map_from_entries(F.collect_list(F.struct(F.coalesce("status", F.lit("")), "_all"))).alias("statuses"),
    ).withColumn("le", F.array(*[F.lit(float(b)) for b in bounds], F.lit(INFINITY)))


def indicator_values(candidates: DataFrame, series: DataFrame) -> DataFrame:
    """``sli_id``, ``step``, ``value``: every candidate in every window of its job and endpoint.

    A candidate is typed: ``quantile`` of the latency histogram, linear inside the bucket
    that holds the rank, in milliseconds; or the percentage of requests whose status
    matches ``status_pattern`` (or not, if ``negated``). Both are read from the one row
    of a window, so all candidates are evaluated in one join.
    """
    asked = candidates.select("sli_id", F.col("service_name").alias("job"), F.col("entry_point").alias("endpoint"), "quantile", "status_pattern", "negated")
    rows = series.join(asked, ["job", "endpoint"])
    n, le = F.col("n"), F.col("le")
    rank = F.element_at(n, -1) * F.col("quantile")
    at = F.array_position(F.transform(n, lambda x: x >= rank), True).cast("int")
    rows = rows.withColumns({"_rank": rank, "_at": F.when(F.element_at(n, -1) > 0, F.nullif(at, F.lit(0)))})
    at = F.col("_at")
    low, below = F.when(at > 1, F.get(le, at - 2)), F.when(at > 1, F.get(n, at - 2)).otherwise(0)
    top, width = F.get(le, at - 1), F.get(n, at - 1) - below
    start = F.coalesce(low, F.when(top > 0, 0.0).otherwise(top))
    inside = start + (top - start) * F.when(width > 0, (F.col("_rank") - below) / width).otherwise(0.0)
    latency = F.when(top == INFINITY, low).otherwise(inside) * 1000
    matched = F.map_filter("statuses", lambda status, _: F.regexp_like(status, F.concat(F.lit("^("), F.col("status_pattern"), F.lit(")$"))) != F.col("negated"))
    count = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + x)
    share = count(matched) / F.nullif(count(F.col("statuses")), F.lit(0)) * 100
    return rows.select("sli_id", "step", F.when(F.col("quantile").isNotNull(), latency).otherwise(share).alias("value"))


class Analysis(NamedTuple):
    journeys: DataFrame
    indicators: DataFrame
    values: DataFrame
    evidence: DataFrame
    objectives: DataFrame
    tested: DataFrame


def analyse(
    spans: DataFrame, requests: DataFrame, capsules: DataFrame, vectors: DataFrame, as_of, days: int = 30,
    window: int = 300, bounds: list[float] | None = None, min_trace_count: int = 10, k: int = 10, min_similarity: float = 0.5,
) -> Analysis:
    """The whole job: journeys of the spans, five indicators of each, their values, evidence, objectives and backtest.

    Every step is stored, as later ones read it more than once; a job that is repeated
    gives the same rows. ``requests`` as in ``request_series``; ``capsules`` and
    ``vectors`` as in ``link_evidence``.
    """
    found = discover_journeys(spans, min_trace_count)
    journeys = materialize(found.withColumn(
        "confidence_score", journey_confidence(F.col("traffic_volume"), F.size("sample_trace_ids"), F.size("step_sequence"))), "journeys")
    service = F.substring_index("entry_point", ":", 1)
    indicators = indicator_candidates(journeys.withColumnRenamed("name", "journey_name").withColumn("name", F.col("journey_name")), service)
    indicators = materialize(indicators.drop("name", "step_sequence").withColumns(
        {"service_name": service, "sli_id": F.concat_ws("|", "entry_point", "sli_name")}), "indicators")
    values = materialize(indicator_values(indicators, request_series(requests, window, bounds)), "values")
    evidence = materialize(link_evidence(indicators, capsules, vectors, k, min_similarity), "evidence")
    series = values.select(F.col("sli_id").alias("series"), F.timestamp_seconds("step").alias("ts"), "value")
    kinds = series.join(indicators.select(F.col("sli_id").alias("series"), "metric_type"), "series")
    up = F.col("metric_type") == "availability"
    objectives = objective_variants(kinds.filter(~up), ["series"], "value").unionByName(
        objective_variants(kinds.filter(up), ["series"], "value", higher_is_better=True))
    objectives = materialize(objectives, "objectives")
    return Analysis(journeys, indicators, values, evidence, objectives, backtest(series, objectives, as_of, days))
