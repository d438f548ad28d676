"""Indicator candidates, their evidence, and context rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.naming import (
    evidence_query, latency_expression, redaction_status, status_ratio_expression, visible_sample,
)
from tidegauge.functions.scoring import capsule_confidence
from tidegauge.functions.text import redact
from tidegauge.operators.vectors import above_floor, batch_search, embed_terms
from tidegauge.sources.stores import upsert


def indicator_candidates(journeys: DataFrame, service: Column) -> DataFrame:
    """Five indicators per journey: three latency percentiles, error rate, availability.

    Beside its expression a row holds what ``analysis.indicator_values`` evaluates: the
    ``quantile``, or the ``status_pattern`` of requests and whether it is ``negated``.
    """
    entry, name = F.col("entry_point"), F.col("name")

    def row(suffix, kind, expression, unit, sources, quantile=None, pattern=None, negated=None):
        return F.struct(
            F.concat(name, F.lit(suffix)).alias("sli_name"), F.lit(kind).alias("metric_type"),
            expression.alias("metric_definition"), F.lit(unit).alias("unit"),
            F.lit(300).alias("window_seconds"), F.lit(sources).alias("data_source"), F.lit(quantile).cast("double").alias("quantile"),
            F.lit(pattern).cast("string").alias("status_pattern"), F.lit(negated).cast("boolean").alias("negated"),
        )

    rows = [
        row(f"-latency-p{p}", "latency", latency_expression(service, entry, p / 100), "ms", "http_request_duration_seconds", p / 100)
        for p in (50, 95, 99)
    ]
    rows.append(row("-error-rate", "error_rate", status_ratio_expression(service, entry, "=~"), "%", "http_requests_total", None, "5..", False))
    rows.append(row("-availability", "availability", status_ratio_expression(service, entry, "!~"), "%", "http_requests_total,up", None, "5..", True))
    return journeys.select("*", F.inline(F.array(*rows)))


def pick_trace(samples: Column, journey_traces: Column) -> Column:
    """The first sample trace that belongs to the journey, else the first there is."""
    traces = F.filter(
        F.transform(samples, lambda s: s["trace_id"]), lambda t: F.coalesce(t != "", F.lit(False))
    )
    shared = F.filter(traces, lambda t: F.array_contains(journey_traces, t))
    return F.coalesce(F.get(shared, F.lit(0)), F.get(traces, F.lit(0)))


def first_log_sample(samples: Column, template: Column) -> Column:
    """Message of the first sample; the template stands in when it has none."""
    return F.when(F.size(samples) > 0, F.coalesce(F.get(samples, F.lit(0))["message"], template))


def contribution(score: Column, by: list[str]) -> Column:
    """Share of a hit in its group's total score x 100; equal shares when that is zero."""
    group = Window.partitionBy(*by)
    total = F.sum(score).over(group)
    return F.when(total != 0, score / total * 100).otherwise(F.lit(100.0) / F.count(F.lit(1)).over(group))


def hydrate(hits: DataFrame, capsules: DataFrame, sample_files: DataFrame | None = None) -> DataFrame:
    """Hits with capsule metadata and samples: inline ones first, else those from files."""
    out = hits.join(capsules, "capsule_id")
    if sample_files is not None:
        files = sample_files.select("capsule_id", F.col("sample_array").alias("_file"))
        inline = F.when(F.array_size("sample_array") > 0, F.col("sample_array"))
        out = out.join(files, "capsule_id", "left").withColumn("sample_array", F.coalesce(inline, "_file")).drop("_file")
    return out


def link_evidence(
    indicators: DataFrame, capsules: DataFrame, vectors: DataFrame, k: int = 10, min_similarity: float = 0.5,
    timed: bool = False,
) -> DataFrame:
    """Evidence of every indicator: search, hydrate, trace, log sample, weight.

    ``indicators``: sli_id, service_name, sli_name, journey_name, entry_point,
    sample_trace_ids (and time_from, time_to when ``timed``). ``vectors`` embeds the
    capsule templates.
    """
    texts = indicators.select(
        F.col("sli_id").alias("query_id"), "service_name",
        evidence_query(F.col("sli_name"), F.col("journey_name"), F.col("entry_point")).alias("template"),
        *(["time_from", "time_to"] if timed else []),
    )
    fit = capsules.select(F.col("capsule_id").alias("query_id"), "template")
    embedded = embed_terms(texts, "query_id", "template", fit=fit)
    queries = texts.drop("template").join(embedded, "query_id")
    hits = above_floor(batch_search(vectors, queries, k, same=("service_name",), timed=timed), min_similarity)
    rows = hydrate(hits, capsules.drop("service_name")).join(
        indicators.select(F.col("sli_id").alias("query_id"), "service_name", "sample_trace_ids"), "query_id"
    )
    status = redaction_status(F.col("redaction_applied"))
    # samples hold raw messages; only what the strict rules leave is shown
    rows = redact(rows.withColumn("_raw", first_log_sample(F.col("sample_array"), F.col("template"))), "_raw", "_shown", mode="strict")
    return rows.select(
        F.col("query_id").alias("sli_id"), "capsule_id", "service_name", "score", "position", "template", "count",
        pick_trace(F.col("sample_array"), F.col("sample_trace_ids")).alias("trace_id"),
        visible_sample(F.col("_shown"), status).alias("log_sample"),
        status.alias("redaction_status"),
        contribution(F.col("score"), ["query_id"]).alias("confidence_contribution"),
    )


def evidence_summary(links: DataFrame, by: str = "sli_id") -> DataFrame:
    return links.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_evidence_count"),
        F.avg("score").alias("avg_similarity"),
        F.min_by("capsule_id", F.struct((-F.col("score")).alias("s"), "capsule_id")).alias("top_capsule_id"),
        F.max("score").alias("top_similarity"),
        F.count_if(F.col("redaction_status") == "redacted").alias("redacted_count"),
    )


def store_evidence(path: str, links: DataFrame, as_of) -> None:
    """Keeps the links of a run as evidence pointers; a run that is repeated replaces its own rows."""
    stamped = links.withColumn("created_at", F.lit(as_of).cast("timestamp"))
    upsert(path, stamped, ["sli_id", "capsule_id"], "created_at")


def indicators_with_evidence(indicators: DataFrame, pointers: DataFrame) -> DataFrame:
    """Indicators with their evidence, largest contribution first; none gives an empty list.

    A pointer list holds one search's top K entries.
    """
    entry = F.struct((-F.col("confidence_contribution")).alias("order"), "capsule_id", "trace_id", "confidence_contribution")
    packed = pointers.groupBy("sli_id").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.struct(e["capsule_id"].alias("capsule_id"), e["trace_id"].alias("trace_id"),
                               e["confidence_contribution"].alias("confidence_contribution")),
        ).alias("evidence_pointers")
    )
    return indicators.join(packed, "sli_id", "left").withColumn(
        "evidence_pointers",
        F.coalesce("evidence_pointers", F.array().cast("array<struct<capsule_id:string,trace_id:string,confidence_contribution:double>>")),
    )


def context_metrics(evidence: DataFrame, by: str, top: int = 5) -> DataFrame:
    """Total events, distinct templates and the ``top`` templates by count, per group."""
    rank = Window.partitionBy(by).orderBy(F.col("count").desc(), "capsule_id")
    best = (
        evidence.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= top)
        .groupBy(by)
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_r", "template", "count"))),
            lambda e: F.struct(e["template"].alias("template"), e["count"].alias("count")),
        ).alias("top_templates"))
    )
    totals = evidence.groupBy(by).agg(
        F.sum("count").alias("total_events"),
        F.count_distinct("template").alias("unique_templates"),
        F.count(F.lit(1)).alias("capsule_count"),
    )
    return totals.join(best, by)


def context_rows(hits: DataFrame, capsules: DataFrame, by: str = "query_id") -> DataFrame:
    """One context row per query: metrics and evidence pointers for its hits."""
    rows = hydrate(hits.select(by, "capsule_id", "score", "position"), capsules).withColumn(
        "confidence_contribution", capsule_confidence(F.col("count"), F.col("redaction_applied"))
    )
    # a query has at most K hits
    pointers = rows.groupBy(by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "capsule_id", "confidence_contribution"))),
            lambda e: F.struct(e["capsule_id"].alias("capsule_id"), e["confidence_contribution"].alias("confidence_contribution")),
        ).alias("evidence_pointers")
    )
    return context_metrics(rows, by).join(pointers, by)


def update_indicators(indicators: DataFrame, changes: DataFrame, now) -> DataFrame:
    """Applies a change table (sli_id, approved?, metric_definition_override?)."""
    c = changes.select("sli_id", F.col("approved").alias("_a"), F.col("metric_definition_override").alias("_d"))
    now_col = F.lit(now).cast("timestamp")
    return indicators.join(c, "sli_id", "left").withColumns(
        {
            "approved_by": F.when(F.col("_a"), F.lit("system")).when(~F.col("_a"), None).otherwise(F.col("approved_by")),
            "approved_at": F.when(F.col("_a"), now_col).when(~F.col("_a"), None).otherwise(F.col("approved_at")),
            "metric_definition": F.coalesce("_d", "metric_definition"),
        }
    ).drop("_a", "_d")
