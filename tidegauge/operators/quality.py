"""Telemetry quality per service and the gaps it shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.constants import QUALITY_RULES, REQUEST_ID_KEYS, RUM_KEYS
from tidegauge.functions.scoring import overall_quality


def _any_key(keys: list[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in keys])
    return F.exists("sample_array", lambda s: F.arrays_overlap(F.map_keys(s), wanted))


def _truthy(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def in_window(column: str, as_of, days: int) -> Column:
    end = F.lit(as_of).cast("timestamp")
    return F.col(column).between(end - F.make_dt_interval(F.lit(days)), end)


def service_quality(services: DataFrame, capsules: DataFrame, as_of, lookback_days: int = 7) -> DataFrame:
    """Coverage percentages of every active service; zeros for one without capsules.

    Each capsule is reduced to five numbers before the shuffle.
    """
    wanted = F.array(*[F.lit(k) for k in REQUEST_ID_KEYS])
    flags = capsules.filter(in_window("time_bucket", as_of, lookback_days)).select(
        "service_name",
        F.coalesce(_any_key(RUM_KEYS), F.lit(False)).cast("int").alias("rum"),
        F.coalesce(
            F.exists("sample_array", lambda s: _truthy(s["trace_id"]) | _truthy(s["span_id"])), F.lit(False)
        ).cast("int").alias("traced"),
        F.coalesce(F.size(F.filter("sample_array", lambda s: F.size(s) >= 3)), F.lit(0)).alias("structured"),
        F.coalesce(
            F.size(F.filter("sample_array", lambda s: F.arrays_overlap(F.map_keys(s), wanted))), F.lit(0)
        ).alias("with_request"),
        F.coalesce(F.array_size("sample_array"), F.lit(0)).alias("samples"),
    )
    pct = lambda part, whole: F.when(F.sum(whole) > 0, F.sum(part) / F.sum(whole) * 100).otherwise(0.0)
    per_service = flags.groupBy("service_name").agg(
        (F.sum("rum") / F.count(F.lit(1)) * 100).alias("rum_coverage_pct"),
        (F.sum("traced") / F.count(F.lit(1)) * 100).alias("trace_coverage_pct"),
        pct("structured", "samples").alias("structured_log_pct"),
        pct("with_request", "samples").alias("request_id_presence_pct"),
        F.count(F.lit(1)).alias("total_samples"),
    )
    measures = [rule[1] for rule in QUALITY_RULES]
    return (
        services.filter(F.col("status") == "active")
        .select(F.col("name").alias("service_name"))
        .join(per_service, "service_name", "left")
        .fillna(0.0, measures)
        .fillna(0, ["total_samples"])
        .withColumn("overall_quality_score", overall_quality(*[F.col(m) for m in measures]))
    )


def quality_gaps(quality: DataFrame) -> DataFrame:
    """One row per service and measure below its threshold."""
    rows = []
    for metric, column, threshold, cap, kind, _ in QUALITY_RULES:
        value = F.col(column)
        severity = (
            F.when(value < 20, "important").otherwise("nice_to_have") if metric == "rum_coverage"
            else F.lit("critical" if metric == "trace_coverage" else "important")
        )
        rows.append(
            F.struct(
                F.lit(metric).alias("metric_name"), value.alias("current_value"),
                F.lit(threshold).alias("threshold"), severity.alias("severity"),
                F.lit(kind).alias("recommendation_type"),
                F.least(F.lit(cap), F.lit(threshold) - value).alias("expected_uplift"),
            )
        )
    return (
        quality.select("service_name", F.inline(F.array(*rows)))
        .filter(F.col("current_value") < F.col("threshold"))
    )


def recommendations(gaps: DataFrame) -> DataFrame:
    """Instrumentation recommendations that close the gaps."""
    cost = F.create_map(*[F.lit(x) for rule in QUALITY_RULES for x in (rule[4], rule[5])])
    return gaps.select(
        F.md5(F.concat_ws("|", "service_name", "recommendation_type")).alias("recommendation_id"),
        "service_name",
        "recommendation_type",
        F.concat(F.lit("raise "), F.col("metric_name"), F.lit(" to "), F.col("threshold").cast("int").cast("string"), F.lit("%"))
        .alias("description"),
        F.col("expected_uplift").alias("expected_confidence_uplift"),
        cost[F.col("recommendation_type")].alias("implementation_cost"),
        F.col("severity").alias("priority"),
        F.lit("pending").alias("status"),
    )
