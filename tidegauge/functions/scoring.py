"""Confidence, quality and budget formulas as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def capsule_confidence(count: Column, redacted: Column) -> Column:
    base = F.least(F.lit(100.0), F.log10(F.greatest(F.lit(1), count)) * 25)
    return F.least(F.lit(100.0), F.when(redacted, base * 1.1).otherwise(base))


def journey_confidence(traffic: Column, sample_traces: Column, steps: Column) -> Column:
    return F.least(
        F.lit(100.0),
        F.least(F.lit(70.0), F.log10(F.greatest(F.lit(1), traffic)) * 10)
        + F.least(F.lit(10), sample_traces)
        + F.least(F.lit(20), steps * 2),
    )


def sample_size_score(n: Column) -> Column:
    """Linear to 100 samples, logarithmic to 10,000, then a capped linear tail."""
    return (
        F.when(n < 100, n / 100 * 30.0)
        .when(n < 1000, 30.0 + (F.log10(n) - 2.0) * 40.0)
        .when(n < 10000, 70.0 + (F.log10(n) - 3.0) * 25.0)
        .otherwise(95.0 + F.least(F.lit(5.0), (n - 10000) / 10000 * 5.0))
    )


def coverage_score(pct: Column) -> Column:
    return F.when(pct < 50, pct * 0.8).otherwise(pct)


def completeness_score(pct: Column) -> Column:
    return F.when(pct < 80, pct * 0.7).otherwise(pct)


def weighted_confidence(n: Column, coverage: Column, completeness: Column) -> Column:
    return (
        sample_size_score(n) * 0.40
        + coverage_score(coverage) * 0.30
        + completeness_score(completeness) * 0.30
    )


def adjusted_confidence(
    base: Column, n: Column, window_days: Column, rum: Column, coverage: Column, completeness: Column
) -> Column:
    """Penalties and the bonus in their fixed order, clamped to 0..100."""
    factor = reduce(
        lambda a, b: a * b,
        [
            F.when(n < 100, 0.5).otherwise(1.0),
            F.when(window_days < 7, 0.8).otherwise(1.0),
            F.when(rum < 10, 0.9).otherwise(1.0),
        ],
    )
    value = base * factor
    excellent = (coverage > 90) & (completeness > 90) & (n > 10000)
    value = F.when(excellent, F.least(F.lit(100.0), value * 1.1)).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def confidence_uplift(
    n: Column, coverage: Column, completeness: Column, rum_gain: Column, trace_gain: Column
) -> Column:
    """Gain of the unpenalised score when coverage and completeness improve."""
    better = weighted_confidence(
        n,
        F.least(F.lit(100.0), coverage + rum_gain),
        F.least(F.lit(100.0), completeness + trace_gain),
    )
    return F.greatest(F.lit(0.0), better - weighted_confidence(n, coverage, completeness))


def overall_quality(rum: Column, trace: Column, structured: Column, request_id: Column) -> Column:
    return F.round(rum * 0.30 + trace * 0.35 + structured * 0.20 + request_id * 0.15, 2)


def budget_simulation(target: Column, breach_pct: Column) -> Column:
    """What is left of the allowance of 100 - target after the breached share."""
    return F.greatest(F.lit(0.0), (1 - target / 100) * 100 - breach_pct)


def budget_rule(sli: Column, target: Column) -> Column:
    return (sli - target) / (100 - target) * 100


def budget_dashboard(value: Column, threshold: Column) -> Column:
    return (value - threshold) / threshold * 100


def breaches(value: Column, operator: Column, threshold: Column) -> Column:
    """Threshold predicate; an unknown operator never breaches."""
    return (
        F.when(operator == "lt", value < threshold)
        .when(operator == "lte", value <= threshold)
        .when(operator == "gt", value > threshold)
        .when(operator == "gte", value >= threshold)
        .when(operator == "eq", value == threshold)
        .otherwise(F.lit(False))
    )


def queue_saturation(length: Column, capacity: int = 1000) -> Column:
    return length / capacity * 100


def lag_seconds(lag: Column, consumed_rate: Column) -> Column:
    return lag / (consumed_rate + 0.001)


def pool_use(active: Column, idle: Column) -> Column:
    """Share of connections in use; no connections at all gives null."""
    return F.try_divide(active, active + idle)
