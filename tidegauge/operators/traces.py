"""Service graph, journeys and span order from spans.

Keys are (trace, span), so one huge trace still spreads over the cluster. Joins on the
trace alone bring one small row per trace and leave skew to the adaptive skew join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.naming import journey_name, step_label
from tidegauge.functions.scoring import journey_confidence
from tidegauge.operators.quantiles import interpolated_percentiles, upper_median
from tidegauge.session import materialize, smaller_tasks, workspace

SAMPLE_TRACES = 10


def has_error() -> Column:
    return F.coalesce(F.col("attributes")["error"] == "true", F.lit(False))


def dependency_edges(spans: DataFrame) -> DataFrame:
    """Cross-service calls between a parent span and its child, with their number."""
    parent = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service_name").alias("caller"))
    child = spans.filter(F.col("parent_span_id").isNotNull()).select(
        "trace_id", "parent_span_id", F.col("service_name").alias("callee")
    )
    return (
        child.join(parent, ["trace_id", "parent_span_id"])
        .filter(F.col("caller") != F.col("callee"))
        .groupBy("caller", "callee")
        .agg(F.count(F.lit(1)).alias("calls"))
    )


def leaf_spans(spans: DataFrame) -> DataFrame:
    """Spans that no other span names as its parent."""
    parents = spans.filter(F.col("parent_span_id").isNotNull()).select(
        "trace_id", F.col("parent_span_id").alias("span_id")
    )
    return spans.join(parents, ["trace_id", "span_id"], "left_anti")


def trace_summary(spans: DataFrame, root: str = "parent") -> DataFrame:
    """One row per trace: entry point, durations, whether any span failed.

    ``root='parent'`` takes the parentless span (smallest id first); ``root='span_id'``
    takes the smallest span id regardless of parents.
    """
    if root not in ("parent", "span_id"):
        raise ValueError(f"unknown root rule: {root}")
    key = ["span_id"] if root == "span_id" else [F.col("parent_span_id").isNotNull().alias("nested"), "span_id"]
    first = F.min(
        F.struct(*key, step_label(F.col("service_name"), F.col("span_name")).alias("entry"), F.col("duration_ms").alias("ms"))
    )
    return (
        spans.groupBy("trace_id")
        .agg(
            first.alias("_root"),
            F.sum("duration_ms").alias("total_ms"),
            F.bool_or(has_error()).alias("failed"),
            F.count(F.lit(1)).alias("n_spans"),
        )
        .select(
            "trace_id", F.col("_root.entry").alias("entry_point"), "total_ms",
            F.col("_root.ms").alias("root_ms"), "failed", "n_spans",
        )
    )


def exit_points(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """The most frequent leaf label of each entry point; ties go to the smaller label."""
    leaves = leaf_spans(spans).select(
        "trace_id", step_label(F.col("service_name"), F.col("span_name")).alias("exit_point")
    )
    counted = (
        leaves.join(traces.select("trace_id", "entry_point"), "trace_id")
        .groupBy("entry_point", "exit_point")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min_by("exit_point", F.struct((-F.col("n")).alias("n"), "exit_point"))
    return counted.groupBy("entry_point").agg(best.alias("exit_point"))


def step_statistics(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """Per entry point and step: number of spans, upper median duration, error rate."""
    rows = spans.select("trace_id", "service_name", "span_name", "duration_ms", has_error().alias("bad")).join(
        traces.select("trace_id", "entry_point"), "trace_id"
    )
    keys = ["entry_point", "service_name", "span_name"]
    stats = upper_median(rows, keys, "duration_ms", "duration_p50", {"errors": F.col("bad").cast("int")})
    return stats.select(*keys, "n", "duration_p50", (F.col("errors") / F.col("n")).alias("error_rate"))


def discover_journeys(
    spans: DataFrame, min_trace_count: int = 10, min_traffic_volume: int | None = None, root: str = "parent"
) -> DataFrame:
    """User journeys, one per entry point with enough traces.

    The summary, one row per trace, is read four times and therefore written once.
    """
    traces = materialize(trace_summary(spans, root), "traces")
    order = Window.partitionBy("entry_point").orderBy("trace_id")
    samples = (
        traces.select("entry_point", "trace_id")
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= SAMPLE_TRACES)
        .groupBy("entry_point")
        .agg(F.array_sort(F.collect_list("trace_id")).alias("sample_trace_ids"))
    )
    totals = traces.groupBy("entry_point").agg(
        F.count(F.lit(1)).alias("traffic_volume"),
        F.avg("total_ms").alias("avg_duration_ms"),
        F.avg("root_ms").alias("avg_root_ms"),
        F.avg(F.col("failed").cast("double")).alias("error_rate"),
    )
    floor = max(min_trace_count, min_traffic_volume or 0)
    totals = totals.filter(F.col("traffic_volume") >= floor)
    step = F.struct("span_name", "service_name", "duration_p50", "error_rate")
    # one entry per distinct step label of an entry point
    steps = step_statistics(spans, traces).groupBy("entry_point").agg(
        F.array_sort(
            F.collect_list(step),
            lambda a, b: F.when(step_label(a["service_name"], a["span_name"]) < step_label(b["service_name"], b["span_name"]), -1)
            .when(step_label(a["service_name"], a["span_name"]) > step_label(b["service_name"], b["span_name"]), 1)
            .otherwise(0),
        ).alias("step_sequence")
    )
    return (
        totals.join(exit_points(spans, traces), "entry_point")
        .join(samples, "entry_point")
        .join(steps, "entry_point")
        .withColumn("name", journey_name(F.col("entry_point"), F.col("exit_point")))
    )


def latency_spread(steps: Column) -> Column:
    """Population standard deviation of the step medians."""
    medians = F.transform(steps, lambda s: F.coalesce(s["duration_p50"], F.lit(0.0)))
    n = F.size(medians)
    mean = F.aggregate(medians, F.lit(0.0), lambda a, x: a + x) / n
    squares = F.aggregate(medians, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n > 0, F.sqrt(squares / n)).otherwise(F.lit(0.0))


def rank_journeys(
    journeys: DataFrame, group: list[str] | None = None,
    traffic_weight: float = 0.4, error_weight: float = 0.3, latency_weight: float = 0.3,
) -> DataFrame:
    """Criticality rank of journeys, within ``group`` when given, else over all of them."""
    keys = group or []
    scored = journeys.withColumns(
        {
            "latency_variance": latency_spread(F.col("step_sequence")),
            "confidence_score": journey_confidence(
                F.col("traffic_volume"), F.size("sample_trace_ids"), F.size("step_sequence")
            ),
            "latency_p95": F.col("avg_duration_ms") * 1.5,
        }
    )
    # the maxima, the bands and the ranked rows all read it; discovery runs once
    scored = materialize(scored, "ranked-journeys")
    top = scored.groupBy(*keys).agg(F.max("traffic_volume").alias("_mt"), F.max("latency_variance").alias("_mv"))
    # without a group the maxima are exactly one row
    scored = scored.join(top, keys) if keys else scored.join(F.broadcast(top), F.lit(True))
    share = lambda c, m: F.when(F.col(m) > 0, F.col(c) / F.col(m)).otherwise(0.0)
    scored = scored.withColumn(
        "business_impact_score",
        (share("traffic_volume", "_mt") * traffic_weight + F.col("error_rate") * error_weight
         + share("latency_variance", "_mv") * latency_weight) * 100,
    ).drop("_mt", "_mv")
    # the score is rounded so that equal scores tie and the name decides
    scored = scored.withColumn("_score", F.round("business_impact_score", 9))
    if keys:
        order = Window.partitionBy(*keys).orderBy(F.col("_score").desc(), "entry_point")
        return scored.withColumn("rank", F.row_number().over(order)).drop("_score")
    # a rank over all journeys: ranked inside score bands, offset by the bands above, so
    # that no task ever holds them all; there are about ten thousand bands
    scored = scored.withColumn("_band", F.floor(F.col("_score") * 100))
    above = Window.orderBy(F.col("_band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bands = scored.groupBy("_band").agg(F.count(F.lit(1)).alias("_n")).select(
        "_band", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above")
    )
    order = Window.partitionBy("_band").orderBy(F.col("_score").desc(), "entry_point")
    return (
        scored.join(F.broadcast(bands), "_band")
        .withColumn("rank", F.col("_above") + F.row_number().over(order))
        .drop("_score", "_band", "_above")
    )


def top_journeys(ranked: DataFrame, n: int = 5, min_confidence: float = 70.0) -> DataFrame:
    """The first ``n`` by rank among the confident ones: rank first, then filter."""
    return ranked.filter(F.col("confidence_score") >= min_confidence).orderBy("rank").limit(n)


def confident_journeys(journeys: DataFrame, min_confidence: float = 50.0) -> DataFrame:
    return journeys.filter(F.col("confidence_score") >= min_confidence).orderBy(
        F.col("confidence_score").desc(), "entry_point"
    )


def duration_percentiles(spans: DataFrame) -> DataFrame:
    """True interpolated p95 of the trace duration beside the estimated one."""
    traces = trace_summary(spans)
    exact = interpolated_percentiles(traces, ["entry_point"], "total_ms", {"true_p95": 0.95})
    est = traces.groupBy("entry_point").agg((F.avg("total_ms") * 1.5).alias("estimated_p95"))
    return exact.join(est, "entry_point")


def breadth_first_order(spans: DataFrame) -> DataFrame:
    """Position of every span in the breadth-first walk from its trace's root.

    Ancestor chains are found by pointer doubling: each round joins spans to the span
    their pointer reaches, so a trace of depth d takes log2(d) rounds. ``path`` lists
    the sibling keys from the root down; spans are ordered by depth, then path. The
    positions of one depth level are ranked apart and offset by the sizes of the levels
    above. Rounds are cut by a written table.

    Spans delivered twice count once; of differing parents a missing one, then the
    smallest, holds. After round r every span down to depth 2**r is settled, so a round
    that settles none leaves only spans that no root reaches: those of a cycle, those
    whose parent is missing, and all below them. They are left out. In a trace without a
    root every span keeps its input id order at depth 0.
    """
    own = spans.groupBy("trace_id", "span_id").agg(
        F.bool_or(F.col("parent_span_id").isNull()).alias("top"), F.min("parent_span_id").alias("parent")
    ).select("trace_id", "span_id", F.when(~F.col("top"), F.col("parent")).alias("parent_span_id"))
    first_root = own.filter(F.col("parent_span_id").isNull()).groupBy("trace_id").agg(F.min("span_id").alias("root_id"))
    nodes = own.join(first_root, "trace_id", "left")
    rootless = F.col("root_id").isNull()
    is_root = F.col("span_id") == F.col("root_id")
    state = nodes.select(
        "trace_id", "span_id",
        F.when(rootless | is_root, None).otherwise(F.col("parent_span_id")).alias("up"),
        F.array("span_id").alias("path"),
        F.coalesce(rootless | is_root, F.lit(False)).alias("done"),
    ).filter(F.col("done") | F.col("up").isNotNull())

    def land(df: DataFrame) -> DataFrame:
        # settled and moving spans in folders of their own
        path = workspace(spans.sparkSession, "walk")
        with smaller_tasks(spans.sparkSession):
            df.write.partitionBy("done").parquet(path)
        return spans.sparkSession.read.schema(df.schema).parquet(path)

    state = land(state)
    settled, moving = [state.filter("done")], state.filter("not done")
    while not moving.isEmpty():
        # every moving pointer jumps to where its target points; one that has reached a
        # settled span is settled too
        targets = reduce(lambda a, b: a.unionByName(b), [*settled, moving]).select(
            "trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"),
            F.col("path").alias("path2"), F.col("done").alias("done2"),
        )
        jumped = land(moving.join(targets, ["trace_id", "up"]).select(
            "trace_id", "span_id", F.col("up2").alias("up"), F.concat("path2", "path").alias("path"),
            F.col("done2").alias("done"),
        ))
        reached, moving = jumped.filter("done"), jumped.filter("not done")
        if reached.isEmpty():
            break
        settled.append(reached)
    state = reduce(lambda a, b: a.unionByName(b), settled)
    walk = state.withColumn("depth", F.size("path") - 1)
    level = walk.groupBy("trace_id", "depth").agg(F.count(F.lit(1)).alias("_n"))
    above_levels = Window.partitionBy("trace_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    offsets = level.select(
        "trace_id", "depth", F.coalesce(F.sum("_n").over(above_levels), F.lit(0)).alias("_offset")
    )
    in_level = Window.partitionBy("trace_id", "depth").orderBy("path")
    return (
        walk.join(offsets, ["trace_id", "depth"])
        .withColumn("position", F.col("_offset") + F.row_number().over(in_level))
        .select("trace_id", "span_id", "depth", "position")
    )
