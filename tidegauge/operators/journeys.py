"""Keeping the journey table: merge, staleness, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scoring import adjusted_confidence, weighted_confidence

REFRESHED = ["traffic_volume_per_day", "confidence_score", "sample_trace_ids"]


def merge_journeys(existing: DataFrame, found: DataFrame, now) -> DataFrame:
    """Upsert on (service_id, name).

    A known journey gets new traffic, confidence, traces and ``last_seen_at``; its
    steps and end points stay. An unknown one is added whole.
    """
    keys = ["service_id", "name"]
    now_col = F.lit(now).cast("timestamp")
    old, new = existing.alias("o"), found.alias("n")
    joined = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    is_new, is_seen = F.col("o.name").isNull(), F.col("n.name").isNotNull()
    out = []
    for c in existing.columns:
        kept, fresh = F.col(f"o.{c}"), (F.col(f"n.{c}") if c in found.columns else F.lit(None))
        if c in REFRESHED:
            value = F.when(is_seen, fresh).otherwise(kept)
        elif c == "last_seen_at":
            value = F.when(is_seen, now_col).otherwise(kept)
        elif c == "discovered_at":
            value = F.when(is_new, now_col).otherwise(kept)
        else:
            value = F.when(is_new, fresh).otherwise(kept)
        out.append(value.alias(c))
    return joined.select(*out)


def decay_stale(journeys: DataFrame, run_date, threshold_days: int = 7) -> DataFrame:
    """Halves the confidence of journeys not seen lately, once per run date."""
    run = F.lit(run_date).cast("timestamp")
    stale = F.col("last_seen_at") < run - F.make_dt_interval(F.lit(threshold_days))
    if "decayed_on" not in journeys.columns:
        journeys = journeys.withColumn("decayed_on", F.lit(None).cast("date"))
    due = stale & ~F.coalesce(F.col("decayed_on") == F.to_date(run), F.lit(False))
    return journeys.withColumns(
        {
            "confidence_score": F.when(due, F.col("confidence_score") * 0.5).otherwise(F.col("confidence_score")),
            "decayed_on": F.when(due, F.to_date(run)).otherwise(F.col("decayed_on")),
        }
    )


def capsule_coverage(journeys: DataFrame, capsules: DataFrame) -> DataFrame:
    """Share of a journey's hours that have capsules of its service.

    Capsules are reduced to one row per service and hour, completed to every hour and
    accumulated. A range is then the difference of two running totals found by equality,
    so a journey of a year costs the same two lookups as one of an hour.
    ``coverage_pct`` counts capsules, ``hour_coverage_pct`` counts distinct hours.
    """
    hour = 3600
    filled = capsules.groupBy("service_name", F.unix_seconds("time_bucket").alias("h")).agg(
        F.count(F.lit(1)).alias("n")
    )
    bounds = filled.groupBy("service_name").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    upto = Window.partitionBy("service_name").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = (
        bounds.select("service_name", F.explode(F.sequence("lo", "hi", F.lit(hour))).alias("h"))
        .join(filled, ["service_name", "h"], "left")
        .select(
            "service_name", "h", F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("n"),
            F.count("n").over(upto).alias("hours"),
        )
    )
    j = journeys.select("journey_id", "service_name", "discovered_at", "last_seen_at").join(bounds, "service_name", "left")
    first = F.ceil(F.unix_seconds("discovered_at") / hour) * hour
    last = F.floor(F.unix_seconds("last_seen_at") / hour) * hour
    j = j.withColumns(
        {
            "_to": F.when((last >= F.col("lo")) & (first <= F.col("hi")) & (first <= last), F.least(last, F.col("hi"))),
            "_from": F.greatest(first, F.col("lo")) - hour,
        }
    )

    def total_at(column: str, out: str) -> DataFrame:
        return totals.select("service_name", F.col("h").alias(column), F.struct("n", "hours").alias(out))

    expected = F.greatest(
        F.lit(1.0), (F.unix_seconds("last_seen_at") - F.unix_seconds("discovered_at")) / hour
    )
    inside = lambda f: F.coalesce(F.col("_end")[f] - F.coalesce(F.col("_start")[f], F.lit(0)), F.lit(0))
    return (
        j.join(total_at("_to", "_end"), ["service_name", "_to"], "left")
        .join(total_at("_from", "_start"), ["service_name", "_from"], "left")
        .withColumns({"capsules": inside("n"), "hours": inside("hours")})
        .select(
            "journey_id", "capsules", "hours",
            F.least(F.lit(100.0), F.col("capsules") / expected * 100).alias("coverage_pct"),
            F.least(F.lit(100.0), F.col("hours") / expected * 100).alias("hour_coverage_pct"),
        )
    )


def step_completeness(steps: Column) -> Column:
    """Share of steps with a known median, 0 without steps."""
    total = F.size(steps)
    known = F.size(F.filter(steps, lambda s: s["duration_p50"].isNotNull()))
    return F.when(total > 0, known / total * 100).otherwise(0.0)


def journey_scores(metrics: DataFrame) -> DataFrame:
    """Weighted confidence with penalties from (sample_size, coverage_pct,
    completeness_pct, window_days, rum_pct)."""
    n, cov, comp = F.col("sample_size"), F.col("coverage_pct"), F.col("completeness_pct")
    base = weighted_confidence(n, cov, comp)
    return metrics.withColumns(
        {
            "base_confidence": base,
            "confidence": adjusted_confidence(base, n, F.col("window_days"), F.col("rum_pct"), cov, comp),
        }
    )
