"""Service-level indicators, windows, budgets, alerts and backtests.

Raw observations are folded to one row per series and step before anything is ordered,
so windows over a series hold at most one row per step of the time range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.constants import ALERT_RULES, HISTOGRAM_BOUNDS, OBJECTIVE_VARIANTS
from tidegauge.functions.scoring import breaches, budget_dashboard, budget_rule, budget_simulation
from tidegauge.operators.quantiles import interpolated_percentiles


def step_start(ts: Column, seconds: int) -> Column:
    """Start of the step a time falls in, as epoch seconds."""
    return F.floor(F.unix_seconds(ts) / seconds) * seconds


def ratio(df: DataFrame, keys: list[str], good: Column, total: Column | None = None, out: str = "sli") -> DataFrame:
    """good / total x 100 per label set, both counted in the same pass."""
    population = F.count(F.lit(1)) if total is None else F.count_if(total)
    part = F.count_if(good) if total is None else F.count_if(good & total)
    return df.groupBy(*keys).agg(part.alias("good"), population.alias("total")).withColumn(
        out, F.when(F.col("total") > 0, F.col("good") / F.col("total") * 100)
    )


def objective_status(df: DataFrame, target: float, sli: str = "sli") -> DataFrame:
    """1 when the indicator meets its target, 0 when it does not."""
    return df.withColumn("slo_status", F.when(F.col(sli) >= target, 1).otherwise(0))


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative bucket counts, plus the count of everything as ``le = +Inf``.

    All buckets are conditional counts of one pass; rows are never multiplied.
    """
    wide = df.groupBy(*keys).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)],
        F.count(F.col(value)).alias("_inf"),
    )
    entries = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_inf").alias("n")))
    return wide.select(*keys, F.inline(F.array(*entries)))


def own_histograms(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """``metric, le, n``: cumulative counts of several own metrics over their fixed bounds, all in one pass."""
    columns, entries = [], []
    for metric, value in values.items():
        bounds = HISTOGRAM_BOUNDS[metric]
        found = [F.count_if(value <= b).alias(f"_{metric}_{i}") for i, b in enumerate(bounds)] + [F.count(value).alias(f"_{metric}_inf")]
        columns += found
        names = [f"_{metric}_{i}" for i in range(len(bounds))] + [f"_{metric}_inf"]
        entries += [F.struct(F.lit(metric).alias("metric"), F.lit(float(b)).alias("le"), F.col(n).alias("n")) for b, n in zip([*bounds, float("inf")], names)]
    return df.groupBy(*keys).agg(*columns).select(*keys, F.inline(F.array(*entries)))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float, count: str = "n") -> DataFrame:
    """Quantile of cumulative buckets, linear inside the bucket that holds the rank.

    A rank in the open last bucket gives the highest finite bound. A first bucket with a
    positive bound starts at zero. Groups hold one row per bound.
    """
    order = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    rows = buckets.withColumns(
        {
            "_low": F.lag("le").over(order),
            "_below": F.coalesce(F.lag(count).over(order), F.lit(0)),
            "_total": F.max(count).over(whole),
        }
    ).withColumn("_rank", F.col("_total") * q)
    hit = rows.filter((F.col(count) >= F.col("_rank")) & (F.col("_total") > 0)).groupBy(*keys).agg(
        F.min_by(F.struct("le", "_low", "_below", F.col(count).alias("n"), "_rank"), "le").alias("h")
    )
    le, low, h = F.col("h.le"), F.col("h._low"), F.col("h")
    start = F.coalesce(low, F.when(le > 0, 0.0).otherwise(le))
    width = h["n"] - h["_below"]
    inside = start + (le - start) * F.when(width > 0, (h["_rank"] - h["_below"]) / width).otherwise(0.0)
    return hit.select(*keys, F.when(le == float("inf"), low).otherwise(inside).alias("quantile"))


def joined_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on labels, of which a missing one equals a missing one."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def counter_increments(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Increase since the previous sample of a series; a drop means a reset.

    Samples are ordered per series and day. The last sample of a day is handed to the
    next day through a table with one row per series and day, so a long series is not
    one task's work.
    """
    day = samples.withColumn("_day", F.to_date("ts"))
    within = Window.partitionBy(*keys, "_day").orderBy("ts")
    last = day.groupBy(*keys, "_day").agg(F.max_by(value, "ts").alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_day")
    carried = last.select(*keys, "_day", F.lag("_last").over(across).alias("_carry"))
    rows = joined_on(day.withColumn("_prev", F.lag(value).over(within)), carried, [*keys, "_day"])
    prev = F.coalesce("_prev", "_carry")
    return rows.withColumn(
        "increase", F.when(prev.isNull(), 0.0).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev)
    ).drop("_day", "_prev", "_carry")


def counter_rate(samples: DataFrame, keys: list[str], by: list[str], seconds: int = 300) -> DataFrame:
    """Per-second rate of counters per step, summed over the series of a label set."""
    grown = counter_increments(samples, keys)
    return (
        grown.groupBy(*by, step_start(F.col("ts"), seconds).alias("step"))
        .agg(F.sum("increase").alias("increase"))
        .withColumn("rate", F.col("increase") / seconds)
    )


def sliding_rate(
    samples: DataFrame, keys: list[str], by: list[str], seconds: int = 300, step: int = 60, value: str = "value", edges: bool = True,
) -> DataFrame:
    """Per-second rate over the trailing range (t - ``seconds``, t] at every multiple t of ``step``, summed over series.

    A series counts where the range holds two samples or more. Its increase comes from
    running totals at the first and the last of them, with resets taken into account.
    With ``edges`` it is extended to the ends of the range by the published rule: to the
    end itself where the nearest sample is within 1.1 mean sample distances, else by
    half a distance, and at the start never to before the counter was zero.

    A sample is the last of a range for the steps up to the next sample, and the first
    for those whose range starts after the sample before. Both are listed and meet, so
    the rows are as many as the steps that are answered, whatever the gaps. Order is made
    per series and day; one row per series and day carries it on.
    """
    ms = F.unix_millis("ts")
    rows = samples.groupBy(*keys, "ts").agg(F.max(value).alias("_v")).withColumns({"_at": ms, "_day": F.to_date("ts")})
    within = Window.partitionBy(*keys, "_day").orderBy("_at")
    days = rows.groupBy(*keys, "_day").agg(F.min("_at").alias("_open"), F.max("_at").alias("_close"), F.max_by("_v", "_at").alias("_last"), F.count("_at").alias("_k"))
    across = Window.partitionBy(*keys).orderBy("_day")
    days = days.select(*keys, "_day", F.lag("_close").over(across).alias("_t0"), F.lag("_last").over(across).alias("_v0"), F.lead("_open").over(across).alias("_t1"),
                       F.coalesce(F.sum("_k").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_k0"))
    rows = rows.withColumns({"_pv": F.lag("_v").over(within), "_pt": F.lag("_at").over(within), "_nt": F.lead("_at").over(within), "_i": F.row_number().over(within)})
    rows = joined_on(rows, days, [*keys, "_day"])
    before = F.coalesce("_pv", "_v0")
    rows = rows.withColumns({
        "_up": F.when(before.isNull(), 0.0).when(F.col("_v") < before, F.col("_v")).otherwise(F.col("_v") - before),
        "_pt": F.coalesce("_pt", "_t0"), "_nt": F.coalesce("_nt", "_t1"), "_n": F.col("_i") + F.col("_k0"),
    })
    grown = rows.groupBy(*keys, "_day").agg(F.sum("_up").alias("_d"))
    grown = grown.select(*keys, "_day", F.coalesce(F.sum("_d").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_c0"))
    total = F.sum("_up").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = joined_on(rows.withColumn("_c", total), grown, [*keys, "_day"]).withColumn("_c", F.col("_c") + F.col("_c0"))
    width, grid = seconds * 1000, step * 1000

    def steps(low: Column, high: Column) -> Column:
        """Multiples of the step from ``low`` to ``high``, both included."""
        first, last = F.ceil(low / grid) * grid, F.floor(high / grid) * grid
        return F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(grid).cast("bigint")))

    ends = F.least(F.coalesce(F.col("_nt") - 1, F.col("_at") + width - 1), F.col("_at") + width - 1)
    last = rows.select(*keys, "_at", "_c", "_n", F.explode(steps(F.col("_at"), ends)).alias("t"))
    begins = F.greatest(F.col("_at"), F.coalesce(F.col("_pt") + width, F.col("_at")))
    first = rows.select(*keys, F.explode(steps(begins, F.col("_at") + width - 1)).alias("t"),
                        F.col("_at").alias("_f_at"), F.col("_c").alias("_f_c"), F.col("_n").alias("_f_n"), F.col("_v").alias("_f_v"))
    met = joined_on(last, first, [*keys, "t"]).filter(F.col("_n") > F.col("_f_n"))
    met = met.withColumns({"increase": F.col("_c") - F.col("_f_c"), "_span": F.col("_at") - F.col("_f_at")})
    if edges:
        mean = F.col("_span") / (F.col("_n") - F.col("_f_n"))
        at_start, at_end = F.col("_f_at") - (F.col("t") - width), F.col("t") - F.col("_at")
        at_start = F.when(at_start >= mean * 1.1, mean / 2).otherwise(at_start)
        to_zero = F.when((F.col("increase") > 0) & (F.col("_f_v") >= 0), F.col("_span") * F.col("_f_v") / F.col("increase"))
        at_start = F.least(at_start, F.coalesce(to_zero, at_start))
        at_end = F.when(at_end >= mean * 1.1, mean / 2).otherwise(at_end)
        met = met.withColumn("increase", F.col("increase") * (F.col("_span") + at_start + at_end) / F.col("_span"))
    out = met.groupBy(*by, (F.col("t") / 1000).cast("bigint").alias("step")).agg(F.sum("increase").alias("increase"))
    return out.withColumn("rate", F.col("increase") / seconds)


def dense_steps(folded: DataFrame, keys: list[str], seconds: int, measures: list[str]) -> DataFrame:
    """One row per series and step between the first and last step, zero where empty."""
    span = folded.agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    # series are distinct label sets; the time range is one row
    grid = folded.select(*keys).distinct().join(F.broadcast(span), F.lit(True)).select(
        *keys, F.explode(F.sequence("lo", "hi", F.lit(seconds))).alias("step")
    )
    return joined_on(grid, folded, [*keys, "step"], "left").fillna(0, measures)


def multi_window(
    df: DataFrame, keys: list[str], ts: str, good: Column, windows: dict[str, int], step: int = 300,
    between: tuple[int, int] | None = None,
) -> DataFrame:
    """good/total x 100 over several trailing windows at every step.

    The counts of a step enter every window there and leave it one window later. Running
    sums over these edges hold between an edge and the next, so a series is as long as
    its edges, however far apart they are and however long a window is. Steps are made
    on output: from the first to the last step of the data, or those ``between`` two
    epoch seconds, both included.
    """
    folded = df.groupBy(*keys, step_start(F.col(ts), step).alias("step")).agg(
        F.count_if(good).alias("good"), F.count(F.lit(1)).alias("total")
    )
    every = {"_own": step, **windows}
    sums = [c for name in every for c in (f"_g_{name}", f"_t_{name}")]

    def edge(at: Column, leaves: str | None) -> Column:
        values = []
        for name in every:
            part = F.lit(1) if leaves is None else F.lit(-1 if leaves == name else 0)
            values += [(F.col("good") * part).alias(f"_g_{name}"), (F.col("total") * part).alias(f"_t_{name}")]
        return F.struct(at.cast("bigint").alias("at"), *values)

    edges = folded.select(*keys, F.inline(F.array(edge(F.col("step"), None), *[edge(F.col("step") + w, name) for name, w in every.items()])))
    if between is None:
        asked = folded.agg(F.min("step").alias("_lo"), F.max("step").alias("_hi"))  # one row
    else:
        lo, hi = -(-int(between[0]) // step) * step, int(between[1]) // step * step
        asked = df.sparkSession.createDataFrame([(lo, hi)], "_lo bigint, _hi bigint")
    asked = F.broadcast(asked)
    # every series is asked from the first step on; what came before is in its sums there
    starts = folded.select(*keys).distinct().join(asked, F.lit(True)).select(*keys, F.col("_lo").alias("at"), *[F.lit(0).cast("bigint").alias(c) for c in sums])
    met = edges.unionByName(starts).join(asked, F.lit(True)).filter(F.col("at") <= F.col("_hi"))
    met = met.groupBy(*keys, F.greatest("at", "_lo").alias("at"), "_lo", "_hi").agg(*[F.sum(c).alias(c) for c in sums])
    order = Window.partitionBy(*keys).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = met.withColumns({c: F.sum(c).over(upto) for c in sums}).withColumn("_end", F.coalesce(F.lead("at").over(order) - step, F.col("_hi")))
    rows = held.filter(F.col("_end") >= F.col("at")).select(*keys, F.explode(F.sequence("at", "_end", F.lit(step).cast("bigint"))).alias("step"), *sums)
    return rows.select(*keys, "step", F.col("_g__own").alias("good"), F.col("_t__own").alias("total"),
                       *[F.when(F.col(f"_t_{n}") > 0, F.col(f"_g_{n}") / F.col(f"_t_{n}") * 100).alias(n) for n in windows])


def _spends(sli: str, target: float, factor: float) -> Column:
    # both sides are rounded, so an error rate exactly at the limit does not fire
    limit = round(factor * (1 - target), 9)
    return F.coalesce(F.round(1 - F.col(sli) / 100, 9) > limit, F.lit(False))


def burn_rate_alert(df: DataFrame, short: str, long: str, target: float, factor: float = 14.4) -> DataFrame:
    """Both windows spend the error budget faster than ``factor`` times the allowed rate."""
    return df.withColumn("burning", _spends(short, target, factor) & _spends(long, target, factor))


def burn_rate_single(df: DataFrame, sli: str, traffic: str, target: float, factor: float = 6.0) -> DataFrame:
    """One-window burn alert that needs traffic."""
    return df.withColumn("burning", _spends(sli, target, factor) & (F.col(traffic) > 0))


def runs(df: DataFrame, keys: list[str], flag: str, step: int, order: str = "step") -> DataFrame:
    """Unbroken runs of steps where ``flag`` holds: start, end, steps, seconds.

    A run breaks where the flag is false or a step is missing: the step number minus the
    rank among flagged steps is constant inside a run. Only flagged rows are shuffled.
    """
    ordered = Window.partitionBy(*keys).orderBy(order)
    flagged = df.filter(F.col(flag)).withColumn(
        "_island", F.col(order) - F.row_number().over(ordered) * step
    )
    return (
        flagged.groupBy(*keys, "_island")
        .agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("steps"))
        .withColumn("seconds", F.col("run_end") - F.col("run_start") + step)
        .drop("_island")
    )


def sustained(df: DataFrame, keys: list[str], flag: str, step: int, hold_seconds: int) -> DataFrame:
    """Runs that last at least ``hold_seconds``; ``fires_at`` is when the wait is over."""
    return (
        runs(df, keys, flag, step)
        .filter(F.col("run_end") - F.col("run_start") >= hold_seconds)
        .withColumn("fires_at", F.col("run_start") + hold_seconds)
    )


def alert_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ALERT_RULES, "alert string, signal string, op string, threshold double, minutes int, severity string, component string"
    )


def evaluate_alerts(signals: DataFrame, keys: list[str], step: int = 300, rules: DataFrame | None = None) -> DataFrame:
    """Firing alerts from ``(keys, signal, step, value)``; every rule in one pass.

    The built-in rules are a fixed short list, hence the broadcast; how rules of the
    caller are joined is left to the optimizer, which knows their size.
    """
    rules = F.broadcast(alert_rules(signals.sparkSession)) if rules is None else rules
    matched = signals.join(rules, "signal").withColumn(
        "breached", breaches(F.col("value"), F.col("op"), F.col("threshold"))
    )
    held = runs(matched, [*keys, "alert", "severity", "component", "minutes"], "breached", step)
    return held.filter(F.col("run_end") - F.col("run_start") >= F.col("minutes") * 60)


def stalled_consumers(df: DataFrame, rate: str = "rate", lag: str = "lag") -> DataFrame:
    return df.withColumn("stalled", (F.col(rate) == 0) & (F.col(lag) > 0))


def breach_events(series: DataFrame, objectives: DataFrame, key: str = "series") -> DataFrame:
    """Every sample that breaches an objective, one row per step."""
    return series.join(objectives, key).filter(
        breaches(F.col("value"), F.col("comparison_operator"), F.col("threshold_value"))
    )


def backtest(
    series: DataFrame, objectives: DataFrame, as_of, lookback_days: int = 30, key: str = "series",
    threshold_override: float | None = None,
) -> DataFrame:
    """Breach statistics of all objectives over the history of their series at once.

    Equal values of a series are counted before they meet the objectives, so a series
    holding a third of all samples enters the join as its distinct values.
    """
    end = F.lit(as_of).cast("timestamp")
    history = (
        series.filter(F.col("ts").between(end - F.make_dt_interval(F.lit(lookback_days)), end))
        .groupBy(key, "value").agg(F.count(F.lit(1)).alias("_c"))
    )
    limits = objectives if threshold_override is None else objectives.withColumn(
        "threshold_value", F.lit(float(threshold_override))
    )
    limits = limits.dropDuplicates()  # an objective that is given twice counts once
    bad = breaches(F.col("value"), F.col("comparison_operator"), F.col("threshold_value"))
    # an inner join first: its skewed sides can be split, those of an outer join cannot
    met = history.join(limits, key).groupBy(*limits.columns).agg(
        F.coalesce(F.sum(F.when(bad, F.col("_c"))), F.lit(0)).alias("breach_count"), F.sum("_c").alias("total_samples")
    )
    stats = joined_on(limits, met, limits.columns, "left").fillna(0, ["breach_count", "total_samples"])
    pct = F.when(F.col("total_samples") > 0, F.col("breach_count") / F.col("total_samples") * 100).otherwise(0.0)
    return stats.withColumns(
        {
            "breach_percentage": pct,
            "breaches_per_day": F.col("breach_count") / lookback_days,
            "expected_monthly_breaches": F.col("breach_count") / lookback_days * 30,
            "confidence": F.least(F.lit(100.0), F.col("total_samples") / 1000 * 100),
            "error_budget_remaining": budget_simulation(F.col("target_percentage"), pct),
        }
    )


def error_budgets(df: DataFrame) -> DataFrame:
    """The three budget formulas side by side from (sli, target, breach_pct, value, threshold)."""
    return df.withColumns(
        {
            "budget_simulation": budget_simulation(F.col("target"), F.col("breach_pct")),
            "budget_rule": budget_rule(F.col("sli"), F.col("target")),
            "budget_dashboard": budget_dashboard(F.col("value"), F.col("threshold")),
        }
    )


def daily_objective_summary(objectives: DataFrame) -> DataFrame:
    """Deployed objectives per indicator and day of creation."""
    return (
        objectives.filter(F.col("deployed_at").isNotNull())
        .groupBy("sli_id", F.date_trunc("day", "created_at").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("slo_count"), F.avg("error_budget_remaining").alias("avg_budget_remaining"))
    )


def objective_variants(df: DataFrame, keys: list[str], value: str, higher_is_better: bool = False) -> DataFrame:
    """Conservative, balanced and aggressive thresholds from the history of a value.

    When higher is better the matching lower tail is used.
    """
    points = {name: (1 - p if higher_is_better else p) for name, p, _ in OBJECTIVE_VARIANTS}
    found = interpolated_percentiles(df, keys, value, points)
    rows = F.array(
        *[F.struct(F.lit(name).alias("variant"), F.col(name).alias("threshold_value"), F.lit(target).alias("target_percentage"))
          for name, _, target in OBJECTIVE_VARIANTS]
    )
    op = "lt" if higher_is_better else "gt"
    return found.select(*keys, F.inline(rows)).withColumn("comparison_operator", F.lit(op))


def counters(df: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """Counter totals per label set."""
    total = F.count(F.lit(1)) if value is None else F.sum(value)
    return df.groupBy(*keys).agg(total.alias("total"))


def freshness(events: DataFrame, keys: list[str], event_time: str, ingest_time: str, limit: int = 60) -> DataFrame:
    """Ingest lag: share within the limit and the largest lag, from raw observations."""
    lag = F.col(ingest_time).cast("double") - F.col(event_time).cast("double")
    return events.withColumn("lag", lag).groupBy(*keys).agg(
        (F.count_if(F.col("lag") <= limit) / F.count(F.lit(1)) * 100).alias("fresh_pct"),
        F.max("lag").alias("max_lag"),
        F.count(F.lit(1)).alias("n"),
    )
