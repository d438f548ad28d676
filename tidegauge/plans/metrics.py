"""Indicators, windows, budgets, alerts, backtests."""

from pyspark.sql import functions as F

from tidegauge.constants import ALERT_RULES, HISTOGRAM_BOUNDS
from tidegauge.functions import naming, scoring
from tidegauge.operators import metrics as mx
from tidegauge.operators.quantiles import interpolated_percentiles, rank_percentiles
from tidegauge.plans.ctes import REQ
from tidegauge.plans.registry import query, r6
from tidegauge.sources import adapters
from tidegauge.sources.tables import table

HOUR = lambda c: mx.step_start(F.col(c), 3600)
OK5XX = lambda: F.col("status_code") < 500  # noqa: E731  (columns need a session)
WINDOWS = {"sli_1h": 3600, "sli_6h": 21600, "sli_24h": 86400, "sli_30d": 2592000}


def counter_samples(spark, d):
    """Per-minute counter samples by service and status class that restart at midnight."""
    req = adapters.requests(spark, d)
    per_minute = req.groupBy(
        "service", (F.floor(F.col("status_code") / 100)).cast("string").alias("class"),
        mx.step_start(F.col("ts"), 60).alias("minute"),
    ).agg(F.count(F.lit(1)).alias("n"))
    day = F.floor(F.col("minute") / 86400)
    from pyspark.sql import Window

    # one row per minute at most
    w = Window.partitionBy("service", "class", day).orderBy("minute")
    return per_minute.select(
        "service", "class", F.timestamp_seconds("minute").alias("ts"), F.sum("n").over(w).cast("double").alias("value")
    )


_COUNTER = REQ + """,
pm AS (SELECT service, CAST(status_code // 100 AS VARCHAR) AS class, sec // 60 * 60 AS minute, count(*) AS n FROM req GROUP BY ALL),
ctr AS (SELECT service, class, minute, sum(n) OVER (PARTITION BY service, class, minute // 86400 ORDER BY minute) AS value FROM pm),
inc AS (
  SELECT *, lag(value) OVER (PARTITION BY service, class ORDER BY minute) AS prev FROM ctr),
grown AS (SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS increase FROM inc)"""


@query("request_rates", f"""
WITH {_COUNTER}
SELECT service, minute // 300 * 300 AS step, CAST(sum(increase) AS DOUBLE) AS increase, round(sum(increase) / 300.0, 6) AS rate
FROM grown GROUP BY ALL""")
def request_rates(spark, d):
    out = mx.counter_rate(counter_samples(spark, d), ["service", "class"], ["service"], 300)
    return out.select("service", "step", "increase", r6("rate").alias("rate"))


_SLIDING = _COUNTER + """,
cum AS (SELECT service, class, minute, value, sum(increase) OVER w AS c, row_number() OVER w AS n FROM grown WINDOW w AS (PARTITION BY service, class ORDER BY minute)),
tick AS (SELECT service, class, unnest(range(min(minute) // 300 * 300, max(minute) + 900, 300)) AS t FROM cum GROUP BY service, class),
rng AS (SELECT tick.service, tick.class, t, min(minute) AS t0, max(minute) AS t1, arg_min(c, minute) AS c0, arg_max(c, minute) AS c1,
    arg_min(value, minute) AS v0, count(*) - 1 AS k FROM tick JOIN cum ON cum.service = tick.service AND cum.class = tick.class AND minute > t - 900 AND minute <= t GROUP BY ALL),
ext AS (SELECT service, t, c1 - c0 AS up, t1 - t0 AS span, (t1 - t0) / k AS mean, t0 - (t - 900) AS lead_in, t - t1 AS lead_out, v0 FROM rng WHERE k > 0),
cut AS (SELECT *, CASE WHEN lead_in >= mean * 1.1 THEN mean / 2 ELSE lead_in END AS a, CASE WHEN lead_out >= mean * 1.1 THEN mean / 2 ELSE lead_out END AS z FROM ext)"""


@query("request_rates_sliding", f"""
WITH {_SLIDING} SELECT service, t AS step, round(sum(up * (span + CASE WHEN up > 0 AND v0 >= 0 THEN least(a, span * v0 / up) ELSE a END + z) / span) / 900, 6) AS rate
FROM cut GROUP BY service, t""")
def request_rates_sliding(spark, d):
    out = mx.sliding_rate(counter_samples(spark, d), ["service", "class"], ["service"], 900, 300)
    return out.select("service", "step", r6("rate").alias("rate"))


_BOUNDS = HISTOGRAM_BOUNDS["analysis_seconds"]
_HIST = REQ + ",\nhist AS (" + " UNION ALL ".join(
    f"SELECT service, sec // 3600 * 3600 AS hour, {i} AS i, {b} AS le, count(*) FILTER (latency <= {b}) AS n FROM req GROUP BY ALL"
    for i, b in enumerate(_BOUNDS)
) + f" UNION ALL SELECT service, sec // 3600 * 3600, {len(_BOUNDS)}, 'Infinity'::DOUBLE, count(*) FROM req GROUP BY ALL)"


def latency_histogram_rows(spark, d):
    req = adapters.requests(spark, d).select("service", HOUR("ts").alias("hour"), "latency")
    return mx.histogram(req, ["service", "hour"], "latency", _BOUNDS)


@query("latency_histogram", f"""
WITH {_HIST} SELECT service, CASE WHEN isinf(le) THEN -1 ELSE le END AS le, CAST(sum(n) AS BIGINT) AS n FROM hist GROUP BY ALL""")
def latency_histogram(spark, d):
    req = adapters.requests(spark, d).select("service", "latency")
    h = mx.histogram(req, ["service"], "latency", _BOUNDS)
    return h.select("service", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "n")


#: Latencies scaled into the range of each of the own metrics.
_SCALES = {"embedding_seconds": 20, "vector_query_seconds": 50, "vector_query_results": 1, "llm_request_seconds": 4, "analysis_seconds": 1,
           "sli_confidence": 100, "artifact_validation_seconds": 10, "db_query_seconds": 100, "http_request_seconds": 20}


@query("own_histograms", f"""
WITH {REQ}, b AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, {b}::DOUBLE AS le, {s} AS scale" for m, s in _SCALES.items() for b in [*HISTOGRAM_BOUNDS[m], "'Infinity'"])})
SELECT service, metric, CASE WHEN isinf(le) THEN -1 ELSE le END AS le, count(*) FILTER (latency / scale <= le) AS n FROM req CROSS JOIN b GROUP BY ALL""")
def own_histograms(spark, d):
    values = {metric: F.col("latency") / scale for metric, scale in _SCALES.items()}
    h = mx.own_histograms(adapters.requests(spark, d), ["service"], values)
    return h.select("service", "metric", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "n")


def _quantile_sql(q):
    return f"""
SELECT service, hour, {q} AS q, CASE WHEN isinf(le) THEN low ELSE
  low0 + (le - low0) * CASE WHEN n > below THEN (total * {q} - below) / (n - below) ELSE 0 END END AS v
FROM (SELECT *, coalesce(low, 0.0) AS low0, row_number() OVER (PARTITION BY service, hour ORDER BY i) AS rk FROM (
  SELECT *, lag(le) OVER w AS low, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY service, hour) AS total
  FROM hist WINDOW w AS (PARTITION BY service, hour ORDER BY i)) WHERE n >= total * {q})
WHERE rk = 1"""


@query("latency_quantiles", f"""
WITH {_HIST} SELECT service, hour, q, round(v, 6) AS latency FROM ({_quantile_sql(0.5)} UNION ALL {_quantile_sql(0.95)} UNION ALL {_quantile_sql(0.99)})""")
def latency_quantiles(spark, d):
    h = latency_histogram_rows(spark, d)
    keys = ["service", "hour"]
    parts = [
        mx.histogram_quantile(h, keys, q).select(*keys, F.lit(q).alias("q"), r6("quantile").alias("latency"))
        for q in (0.5, 0.95, 0.99)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("ingest_freshness", f"""
WITH {REQ}, s AS (
  SELECT service, environment, count(*) FILTER (latency <= 60) AS good, count(*) AS total, count(*) FILTER (latency <= 60) / count(*) * 100 AS sli
  FROM req GROUP BY ALL)
SELECT service, environment, good, total, round(sli, 6) AS sli, CASE WHEN sli >= 70 THEN 1 ELSE 0 END AS slo_status,
  round((sli - 70) / 30 * 100, 6) AS error_budget_remaining FROM s""")
def ingest_freshness(spark, d):
    s = mx.ratio(adapters.requests(spark, d), ["service", "environment"], F.col("latency") <= 60)
    s = mx.objective_status(s, 70.0)
    return s.select(
        "service", "environment", "good", "total", r6("sli").alias("sli"), "slo_status",
        r6(scoring.budget_rule(F.col("sli"), F.lit(70.0))).alias("error_budget_remaining"),
    )


@query("ratio_indicators", f"""
WITH {REQ}
SELECT service, endpoint, count(*) AS requests,
  round(count(*) FILTER (status_code >= 500) / count(*) * 100, 6) AS error_rate,
  round(count(*) FILTER (status_code BETWEEN 400 AND 499) / count(*) * 100, 6) AS client_error_rate,
  round(count(*) FILTER (status_code < 500) / count(*) * 100, 6) AS availability,
  round(count(*) FILTER (status_code BETWEEN 200 AND 299) / count(*) * 100, 6) AS success_rate
FROM req GROUP BY ALL""")
def ratio_indicators(spark, d):
    code = F.col("status_code")
    pct = lambda cond: r6(F.count_if(cond) / F.count(F.lit(1)) * 100)
    return adapters.requests(spark, d).groupBy("service", "endpoint").agg(
        F.count(F.lit(1)).alias("requests"), pct(code >= 500).alias("error_rate"),
        pct(code.between(400, 499)).alias("client_error_rate"), pct(code < 500).alias("availability"),
        pct(code.between(200, 299)).alias("success_rate"),
    )


@query("success_ratio_in_production", f"""
WITH {REQ}
SELECT service, count(*) FILTER (status_code < 400 AND environment = 'prod') AS good, count(*) FILTER (environment = 'prod') AS total,
  round(CASE WHEN count(*) FILTER (environment = 'prod') > 0 THEN count(*) FILTER (status_code < 400 AND environment = 'prod') / count(*) FILTER (environment = 'prod') * 100 END, 6) AS sli
FROM req GROUP BY service""")
def success_ratio(spark, d):
    s = mx.ratio(adapters.requests(spark, d), ["service"], F.col("status_code") < 400, F.col("environment") == "prod")
    return s.withColumn("sli", r6("sli"))


_GRID = REQ + """,
fold AS (SELECT service, sec // 300 * 300 AS step, count(*) FILTER (status_code < 500) AS good, count(*) AS total FROM req GROUP BY ALL),
grid AS (
  SELECT s.service, g.step, coalesce(f.good, 0) AS good, coalesce(f.total, 0) AS total
  FROM (SELECT DISTINCT service FROM fold) s
  CROSS JOIN (SELECT unnest(range((SELECT min(step) FROM fold), (SELECT max(step) FROM fold) + 1, 300)) AS step) g
  LEFT JOIN fold f ON f.service = s.service AND f.step = g.step),
win AS (
  SELECT service, step, good, total, """ + ", ".join(
    f"CASE WHEN sum(total) OVER w{i} > 0 THEN sum(good) OVER w{i} / sum(total) OVER w{i} * 100 END AS {name}"
    for i, name in enumerate(WINDOWS)
) + " FROM grid WINDOW " + ", ".join(
    f"w{i} AS (PARTITION BY service ORDER BY step ROWS BETWEEN {s // 300 - 1} PRECEDING AND CURRENT ROW)"
    for i, s in enumerate(WINDOWS.values())
) + ")"


def windows(spark, d):
    return mx.multi_window(adapters.requests(spark, d), ["service"], "ts", OK5XX(), WINDOWS)


@query("multi_window_indicator", f"""
WITH {_GRID} SELECT service, step, CAST(total AS BIGINT) AS total, {', '.join(f'round({w}, 6) AS {w}' for w in WINDOWS)} FROM win""")
def multi_window_indicator(spark, d):
    return windows(spark, d).select("service", "step", "total", *[r6(w).alias(w) for w in WINDOWS])


_BURN = _GRID + """,
burn AS (SELECT service, step, sli_1h, total,
  coalesce(round(1 - sli_1h / 100, 9) > 0.25, FALSE) AND coalesce(round(1 - sli_6h / 100, 9) > 0.25, FALSE) AS burning FROM win),
isl AS (SELECT *, step - row_number() OVER (PARTITION BY service ORDER BY step) * 300 AS island FROM burn WHERE burning),
runs AS (SELECT service, min(step) AS run_start, max(step) AS run_end, count(*) AS steps, max(step) - min(step) + 300 AS seconds
  FROM isl GROUP BY service, island)"""


def burning(spark, d):
    return mx.burn_rate_alert(windows(spark, d), "sli_1h", "sli_6h", 0.9, 2.5)


@query("burn_rate_steps", f"WITH {_BURN} SELECT service, count(*) AS steps, count(*) FILTER (burning) AS burning_steps FROM burn GROUP BY service")
def burn_rate_steps(spark, d):
    return burning(spark, d).groupBy("service").agg(F.count(F.lit(1)).alias("steps"), F.count_if("burning").alias("burning_steps"))


@query("burn_rate_runs", f"WITH {_BURN} SELECT * FROM runs")
def burn_rate_runs(spark, d):
    return mx.runs(burning(spark, d), ["service"], "burning", 300)


@query("burn_rate_alerts", f"""
WITH {_BURN} SELECT *, run_start + 600 AS fires_at FROM runs WHERE run_end - run_start >= 600""")
def burn_rate_alerts(spark, d):
    return mx.sustained(burning(spark, d), ["service"], "burning", 300, 600)


@query("single_window_burn", f"""
WITH {_GRID} SELECT service, count(*) FILTER (coalesce(round(1 - CASE WHEN total > 0 THEN good / total * 100 END / 100, 9) > 0.3 AND total > 0, FALSE)) AS burning_steps
FROM win GROUP BY service""")
def single_window_burn(spark, d):
    w = mx.multi_window(adapters.requests(spark, d), ["service"], "ts", OK5XX(), {"sli_5m": 300})
    return mx.burn_rate_single(w, "sli_5m", "total", 0.95, 6.0).groupBy("service").agg(F.count_if("burning").alias("burning_steps"))


def slos(spark, d):
    """Three latency objectives per service, with a duration text for the window."""
    services = adapters.requests(spark, d).select("service").distinct()
    kinds = F.array(
        F.struct(F.lit("gt").alias("comparison_operator"), F.lit(120.0).alias("threshold_value"), F.lit(95.0).alias("target_percentage"), F.lit("30d").alias("time_window")),
        F.struct(F.lit("gte").alias("comparison_operator"), F.lit(60.0).alias("threshold_value"), F.lit(50.0).alias("target_percentage"), F.lit("24h").alias("time_window")),
        F.struct(F.lit("near").alias("comparison_operator"), F.lit(1.0).alias("threshold_value"), F.lit(99.0).alias("target_percentage"), F.lit("90m").alias("time_window")),
    )
    return services.select(F.col("service").alias("series"), F.inline(kinds))


def series(spark, d):
    return adapters.requests(spark, d).select(F.col("service").alias("series"), "ts", F.col("latency").alias("value"))


_SLO = REQ + """,
slo AS (SELECT service, op, threshold, target, win FROM (SELECT DISTINCT service FROM req)
  CROSS JOIN (VALUES ('gt', 120.0, 95.0, '30d'), ('gte', 60.0, 50.0, '24h'), ('near', 1.0, 99.0, '90m')) AS v(op, threshold, target, win)),
test AS (
  SELECT slo.*, req.ts, req.event_id, req.latency,
    CASE op WHEN 'gt' THEN latency > threshold WHEN 'gte' THEN latency >= threshold ELSE FALSE END AS bad
  FROM slo JOIN req USING (service))"""


@query("objective_backtest", f"""
WITH {_SLO}, b AS (
  SELECT service AS series, op AS comparison_operator, threshold AS threshold_value, target AS target_percentage, win AS time_window,
    count(*) FILTER (bad) AS breach_count, count(*) AS total_samples, count(*) FILTER (bad) / count(*) * 100 AS pct
  FROM test WHERE ts BETWEEN TIMESTAMP '2024-01-31' - INTERVAL 30 DAY AND TIMESTAMP '2024-01-31' GROUP BY ALL)
SELECT series, comparison_operator, threshold_value, target_percentage, time_window, breach_count, total_samples,
  round(pct, 6) AS breach_percentage, round(breach_count / 30, 6) AS breaches_per_day, round(breach_count / 30 * 30, 6) AS expected_monthly_breaches,
  round(least(100, total_samples / 1000 * 100), 6) AS confidence, round(greatest(0, (1 - target_percentage / 100) * 100 - pct), 6) AS error_budget_remaining
FROM b""")
def objective_backtest(spark, d):
    out = mx.backtest(series(spark, d), slos(spark, d), "2024-01-31", 30)
    return out.select(
        "series", "comparison_operator", "threshold_value", "target_percentage", "time_window", "breach_count", "total_samples",
        *[r6(c).alias(c) for c in ("breach_percentage", "breaches_per_day", "expected_monthly_breaches", "confidence", "error_budget_remaining")],
    )


@query("backtest_with_override", f"""
WITH {_SLO} SELECT service AS series, op AS comparison_operator,
  count(*) FILTER (CASE op WHEN 'gt' THEN latency > 200 WHEN 'gte' THEN latency >= 200 ELSE FALSE END) AS breach_count, count(*) AS total_samples
FROM test GROUP BY ALL""")
def backtest_with_override(spark, d):
    out = mx.backtest(series(spark, d), slos(spark, d), "2024-01-31", 365, threshold_override=200.0)
    return out.select("series", "comparison_operator", "breach_count", "total_samples")


@query("breach_events", f"""
WITH {_SLO} SELECT service AS series, op AS comparison_operator, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, latency AS value FROM test WHERE bad""")
def breach_events(spark, d):
    return mx.breach_events(series(spark, d), slos(spark, d)).select(
        "series", "comparison_operator", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value"
    )


@query("objective_variants", f"""
WITH {REQ}, p AS (
  SELECT service, quantile_cont(latency, 0.999) AS a, quantile_cont(latency, 0.99) AS b, quantile_cont(latency, 0.95) AS c FROM req GROUP BY service)
SELECT service, 'conservative' AS variant, round(a, 6) AS threshold_value, 99.9 AS target_percentage, 'gt' AS comparison_operator FROM p
UNION ALL SELECT service, 'balanced', round(b, 6), 99.0, 'gt' FROM p UNION ALL SELECT service, 'aggressive', round(c, 6), 95.0, 'gt' FROM p""")
def objective_variants(spark, d):
    return mx.objective_variants(adapters.requests(spark, d), ["service"], "latency").withColumn("threshold_value", r6("threshold_value"))


@query("latency_rank_percentiles", f"""
WITH {REQ}, l AS (SELECT service, list_sort(list(latency)) AS v, count(*) AS n, max(latency) AS worst, avg(latency) AS mean FROM req GROUP BY service)
SELECT service, n, v[CAST(floor(n * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(n * 0.99) AS BIGINT) + 1] AS p99,
  worst AS max, round(mean, 6) AS mean FROM l""")
def latency_rank_percentiles(spark, d):
    req = adapters.requests(spark, d)
    ranks = rank_percentiles(req, ["service"], "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    rest = req.groupBy("service").agg(F.max("latency").alias("max"), r6(F.avg("latency")).alias("mean"))
    return ranks.join(rest, "service")


@query("latency_interpolated", f"""
WITH {REQ} SELECT service, endpoint, count(*) AS n, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.9), 6) AS p90
FROM req GROUP BY ALL""")
def latency_interpolated(spark, d):
    out = interpolated_percentiles(adapters.requests(spark, d), ["service", "endpoint"], "latency", {"p50": 0.5, "p90": 0.9})
    return out.select("service", "endpoint", "n", r6("p50").alias("p50"), r6("p90").alias("p90"))


@query("request_counters", f"""
WITH {REQ} SELECT service, environment, CAST(status_code AS VARCHAR) AS status, count(*) AS total FROM req GROUP BY ALL""")
def request_counters(spark, d):
    return mx.counters(adapters.requests(spark, d).withColumn("status", F.col("status_code").cast("string")), ["service", "environment", "status"])


@query("spend_counters", f"WITH {REQ} SELECT service, round(sum(latency), 4) AS total FROM req GROUP BY service")
def spend_counters(spark, d):
    return mx.counters(adapters.requests(spark, d), ["service"], "latency").withColumn("total", F.round("total", 4))


def objective_history(spark, d):
    """Orders as objectives: created with the order, deployed once filled."""
    return table(spark, d, "orders").select(
        F.concat(F.lit("sli-"), F.col("o_custkey").cast("string")).alias("sli_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")).alias("deployed_at"),
        (F.col("o_totalprice") / 1000).alias("error_budget_remaining"),
    )


@query("daily_objective_summary", """
SELECT 'sli-' || o_custkey AS sli_id, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS bucket, count(*) AS slo_count,
  round(avg(o_totalprice / 1000), 8) AS avg_budget_remaining
FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""")
def daily_objective_summary(spark, d):
    return mx.daily_objective_summary(objective_history(spark, d)).select(
        "sli_id", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "slo_count", F.round("avg_budget_remaining", 8).alias("avg_budget_remaining")
    )


@query("error_budgets", f"""
WITH {REQ}, s AS (SELECT service, count(*) FILTER (status_code < 500) / count(*) * 100 AS sli, count(*) FILTER (latency > 60) / count(*) * 100 AS breach_pct,
  avg(latency) AS value FROM req GROUP BY service)
SELECT service, round(greatest(0, (1 - 70 / 100) * 100 - breach_pct), 6) AS budget_simulation, round((sli - 70) / 30 * 100, 6) AS budget_rule,
  round((value - 60) / 60 * 100, 6) AS budget_dashboard FROM s""")
def error_budgets(spark, d):
    n = F.count(F.lit(1))
    s = adapters.requests(spark, d).groupBy("service").agg(
        (F.count_if(OK5XX()) / n * 100).alias("sli"), (F.count_if(F.col("latency") > 60) / n * 100).alias("breach_pct"),
        F.avg("latency").alias("value"),
    ).withColumns({"target": F.lit(70.0), "threshold": F.lit(60.0)})
    out = mx.error_budgets(s)
    return out.select("service", *[r6(c).alias(c) for c in ("budget_simulation", "budget_rule", "budget_dashboard")])


_STEP5 = REQ + """,
st AS (SELECT service, sec // 300 * 300 AS step, count(*) AS n, count(*) FILTER (status_code >= 500) AS bad,
  count(*) FILTER (endpoint = '/view') AS consumed, count(*) FILTER (endpoint <> '/view') AS lag, sum(latency) AS spend, max(latency) AS worst FROM req GROUP BY ALL)"""


def steps5(spark, d):
    return adapters.requests(spark, d).groupBy("service", mx.step_start(F.col("ts"), 300).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~OK5XX()).alias("bad"), F.count_if(F.col("endpoint") == "/view").alias("consumed"),
        F.count_if(F.col("endpoint") != "/view").alias("lag"), F.sum("latency").alias("spend"), F.max("latency").alias("worst"),
    )


@query("saturation_and_lag", f"""
WITH {_STEP5} SELECT service, step, round(n / 1000 * 100, 6) AS queue_saturation, round(lag / (consumed / 300 + 0.001), 6) AS lag_seconds,
  round(bad / (bad + consumed), 6) AS pool_use FROM st WHERE bad + consumed > 0
UNION ALL SELECT service, step, round(n / 1000 * 100, 6), round(lag / (consumed / 300 + 0.001), 6), NULL FROM st WHERE bad + consumed = 0""")
def saturation_and_lag(spark, d):
    return steps5(spark, d).select(
        "service", "step", r6(scoring.queue_saturation(F.col("n"))).alias("queue_saturation"),
        r6(scoring.lag_seconds(F.col("lag"), F.col("consumed") / 300)).alias("lag_seconds"),
        r6(scoring.pool_use(F.col("bad"), F.col("consumed"))).alias("pool_use"),
    )


@query("stalled_consumers", f"""
WITH {_STEP5} SELECT service, step, consumed / 300 = 0 AND lag > 0 AS stalled FROM st""")
def stalled_consumers(spark, d):
    rows = steps5(spark, d).withColumn("rate", F.col("consumed") / 300)
    return mx.stalled_consumers(rows).select("service", "step", "stalled")


SIGNALS = {
    "ingest_lag_p99": (lambda: F.col("worst"), "worst"),
    "ingest_freshness_status": (lambda: F.when(F.col("worst") <= 60, 1.0).otherwise(0.0), "CASE WHEN worst <= 60 THEN 1 ELSE 0 END"),
    "vector_query_p95": (lambda: F.col("worst") / 50, "worst / 50"),
    "vector_query_status": (lambda: F.when(F.col("worst") <= 100, 1.0).otherwise(0.0), "CASE WHEN worst <= 100 THEN 1 ELSE 0 END"),
    "analysis_p95": (lambda: F.col("worst"), "worst"),
    "analysis_status": (lambda: F.when(F.col("bad") == 0, 1.0).otherwise(0.0), "CASE WHEN bad = 0 THEN 1 ELSE 0 END"),
    "embedding_queue_length": (lambda: F.col("spend") * 20, "spend * 20"),
    "model_p95": (lambda: F.col("worst") / 2, "worst / 2"),
    "model_error_ratio": (lambda: F.col("bad") / F.col("n"), "bad / n"),
    "daily_spend_usd": (lambda: F.col("spend"), "spend"),
    "consumer_lag": (lambda: F.col("lag") * 5000, "lag * 5000"),
    "connection_pool_use": (lambda: F.col("lag") / F.col("n"), "lag / n"),
    "db_p95": (lambda: F.col("worst") / 100, "worst / 100"),
    "api_p95": (lambda: F.col("worst") / 20, "worst / 20"),
    "api_success_rate": (lambda: (F.col("n") - F.col("bad")) / F.col("n") * 100, "(n - bad) / n * 100"),
    "ingest_failure_ratio": (lambda: F.col("bad") / F.col("n"), "bad / n"),
    "artifact_failure_ratio": (lambda: F.col("bad") / F.col("n"), "bad / n"),
}
_OPS = {"gt": ">", "lt": "<", "eq": "="}
_ALERT_SQL = " UNION ALL ".join(
    f"SELECT service, step, '{name}' AS alert, '{sev}' AS severity, '{comp}' AS component, {minutes} AS minutes FROM st WHERE {SIGNALS[sig][1]} {_OPS[op]} {limit}"
    for name, sig, op, limit, minutes, sev, comp in ALERT_RULES
)


@query("threshold_alerts", f"""
WITH {_STEP5}, hit AS ({_ALERT_SQL}),
isl AS (SELECT *, step - row_number() OVER (PARTITION BY service, alert ORDER BY step) * 300 AS island FROM hit)
SELECT service, alert, severity, component, minutes, min(step) AS run_start, max(step) AS run_end, count(*) AS steps, max(step) - min(step) + 300 AS seconds
FROM isl GROUP BY service, alert, severity, component, minutes, island HAVING max(step) - min(step) >= minutes * 60""")
def threshold_alerts(spark, d):
    rows = F.array(*[F.struct(F.lit(k).alias("signal"), v().cast("double").alias("value")) for k, (v, _) in SIGNALS.items()])
    signals = steps5(spark, d).select("service", "step", F.inline(rows))
    return mx.evaluate_alerts(signals, ["service"], 300)


@query("duration_windows", """
WITH t AS (SELECT event_id, (event_id % 90) || CASE event_id % 5 WHEN 0 THEN 'd' WHEN 1 THEN 'h' WHEN 2 THEN 'm' WHEN 3 THEN 's' ELSE 'w' END AS txt FROM events),
s AS (SELECT event_id, txt, CAST(regexp_extract(txt, '^(\\d+)', 1) AS BIGINT) * CASE right(txt, 1) WHEN 'd' THEN 86400 WHEN 'h' THEN 3600 WHEN 'm' THEN 60 WHEN 's' THEN 1 END AS sec FROM t)
SELECT event_id, txt AS time_window, coalesce(sec, -1) AS seconds, coalesce(CASE WHEN sec % 86400 = 0 THEN (sec // 86400) || 'd' WHEN sec % 3600 = 0 THEN (sec // 3600) || 'h'
  WHEN sec % 60 = 0 THEN (sec // 60) || 'm' WHEN sec IS NOT NULL THEN sec || 's' END, 'invalid') AS shown, coalesce(sec >= 3600, FALSE) AS long_enough FROM s""")
def duration_windows(spark, d):
    e = F.col("event_id")
    unit = F.element_at(F.array(*[F.lit(u) for u in "dhmsw"]), (e % 5 + 1).cast("int"))
    t = table(spark, d, "events").select("event_id", F.concat((e % 90).cast("string"), unit).alias("time_window"))
    sec = naming.duration_seconds(F.col("time_window"))
    return t.select(
        "event_id", "time_window", F.coalesce(sec, F.lit(-1)).alias("seconds"),
        F.coalesce(naming.duration_text(sec), F.lit("invalid")).alias("shown"),
        F.coalesce(sec >= 3600, F.lit(False)).alias("long_enough"),
    )


@query("threshold_predicates", """
SELECT event_id, value < 49.63 AS lt, value <= 49.63 AS lte, value > 49.63 AS gt, value >= 49.63 AS gte, value = 49.63 AS eq, FALSE AS other FROM events""")
def threshold_predicates(spark, d):
    ops = {o: scoring.breaches(F.col("value"), F.lit(o), F.lit(49.63)).alias(o) for o in ("lt", "lte", "gt", "gte", "eq", "other")}
    return table(spark, d, "events").select("event_id", *ops.values())


@query("ingest_lag", """
SELECT event_type, round(count(*) FILTER (value <= 60) / count(*) * 100, 6) AS fresh_pct, round(max(value), 3) AS max_lag, count(*) AS n FROM events GROUP BY event_type""")
def ingest_lag(spark, d):
    ev = table(spark, d, "events").select(
        "event_type", F.col("ts").cast("timestamp").alias("event_time"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1000000).cast("bigint")).alias("ingest_time"),
    )
    return mx.freshness(ev, ["event_type"], "event_time", "ingest_time").select(
        "event_type", r6("fresh_pct").alias("fresh_pct"), F.round("max_lag", 3).alias("max_lag"), "n"
    )
