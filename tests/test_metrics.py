from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import metrics as mx

T0 = datetime(2024, 1, 1, 23, 0)


def test_counter_reset_and_day_boundary(spark):
    values = [5, 8, 2, 4, 10, 1]  # resets at the third and the last sample
    rows = [("s", T0 + timedelta(minutes=20 * i), float(v)) for i, v in enumerate(values)]  # crosses midnight
    got = [r["increase"] for r in mx.counter_increments(spark.createDataFrame(rows, "s string, ts timestamp, value double"), ["s"]).orderBy("ts").collect()]
    assert got == [0, 3, 2, 2, 6, 1]


def test_counter_gap_of_days(spark):
    rows = [("s", T0, 5.0), ("s", T0 + timedelta(days=3), 9.0)]
    out = mx.counter_increments(spark.createDataFrame(rows, "s string, ts timestamp, value double"), ["s"])
    assert out.agg(F.sum("increase")).first()[0] == 4


def test_histogram_quantile(spark):
    df = spark.createDataFrame([("a", v) for v in (0.5, 1.5, 1.5, 3.0, 9.0)], "k string, v double")
    h = mx.histogram(df, ["k"], "v", [1.0, 2.0, 4.0])
    assert [r["n"] for r in h.orderBy("le").collect()] == [1, 3, 4, 5]
    q = lambda p: mx.histogram_quantile(h, ["k"], p).first()["quantile"]
    assert q(0.5) == pytest.approx(1 + (2.5 - 1) / 2)
    assert q(0.99) == 4.0  # open bucket gives the last bound
    assert q(0.1) == pytest.approx(0.5)


def test_windows_and_runs(spark):
    rows = [("s", datetime(2024, 1, 1) + timedelta(minutes=5 * i), i not in (3, 4, 5, 9)) for i in range(12)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, ok boolean")
    w = mx.multi_window(df, ["s"], "ts", F.col("ok"), {"w15": 900, "w5": 300}).orderBy("step").collect()
    assert [r["w5"] for r in w] == [100, 100, 100, 0, 0, 0, 100, 100, 100, 0, 100, 100]
    assert w[4]["w15"] == pytest.approx(100 / 3)
    flagged = spark.createDataFrame([("s", i * 300, i in (3, 4, 5, 9)) for i in range(12)], "s string, step bigint, bad boolean")
    runs = {(r["run_start"], r["steps"], r["seconds"]) for r in mx.runs(flagged, ["s"], "bad", 300).collect()}
    assert runs == {(900, 3, 900), (2700, 1, 300)}
    fired = mx.sustained(flagged, ["s"], "bad", 300, 600).collect()
    assert [r["fires_at"] for r in fired] == [1500]


def test_empty_steps_have_no_ratio(spark):
    rows = [("s", datetime(2024, 1, 1), True), ("s", datetime(2024, 1, 1, 1), True)]
    w = mx.multi_window(spark.createDataFrame(rows, "s string, ts timestamp, ok boolean"), ["s"], "ts", F.col("ok"), {"w5": 300})
    assert w.count() == 13
    assert w.filter("w5 is null").count() == 11


def test_backtest_without_data(spark):
    series = spark.createDataFrame([("a", datetime(2024, 1, 1), 5.0)], "series string, ts timestamp, value double")
    slo = spark.createDataFrame([("a", "gt", 1.0, 99.0), ("b", "gt", 1.0, 99.0)], "series string, comparison_operator string, threshold_value double, target_percentage double")
    got = {r["series"]: r for r in mx.backtest(series, slo, "2024-01-02", 30).collect()}
    assert got["a"]["breach_percentage"] == 100 and got["a"]["error_budget_remaining"] == 0
    assert got["b"]["total_samples"] == 0 and got["b"]["breach_percentage"] == 0


def test_variants_for_higher_is_better(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1001)], "k string, v double")
    up = {r["variant"]: r["threshold_value"] for r in mx.objective_variants(df, ["k"], "v").collect()}
    down = {r["variant"]: r["threshold_value"] for r in mx.objective_variants(df, ["k"], "v", True).collect()}
    assert up == pytest.approx({"conservative": 999, "balanced": 990, "aggressive": 950})
    assert down == pytest.approx({"conservative": 1, "balanced": 10, "aggressive": 50})


def test_burn_rate_needs_both_windows(spark):
    df = spark.createDataFrame([(80.0, 80.0), (80.0, 99.0), (85.6, 80.0), (None, 80.0)], "a double, b double")
    assert [r["burning"] for r in mx.burn_rate_alert(df, "a", "b", 0.99).collect()] == [True, False, False, False]


def test_null_labels_are_a_series(spark):
    from datetime import datetime

    from tidegauge.operators import metrics as mt

    rows = [(None, datetime(2024, 1, 1, 0, i), float(v)) for i, v in enumerate((1, 4, 2))] + [("a", datetime(2024, 1, 2), 5.0)]
    df = spark.createDataFrame(rows, "endpoint string, ts timestamp, value double")
    got = sorted((r["endpoint"] or "", r["increase"]) for r in mt.counter_increments(df, ["endpoint"]).collect())
    assert got == [("", 0.0), ("", 2.0), ("", 3.0), ("a", 0.0)]
    folded = df.groupBy("endpoint", mt.step_start(F.col("ts"), 3600).alias("step")).agg(F.sum("value").alias("v"))
    dense = mt.dense_steps(folded, ["endpoint"], 3600, ["v"])
    assert dense.filter("endpoint IS NULL").agg(F.sum("v")).first()[0] == 7.0


def test_objective_given_twice(spark):
    series = spark.createDataFrame([("a", datetime(2024, 1, 1), float(v)) for v in range(10)], "series string, ts timestamp, value double")
    one = ("a", "gte", 5.0, 99.0)
    slo = spark.createDataFrame([one, one, ("a", "gte", 8.0, 99.0)], "series string, comparison_operator string, threshold_value double, target_percentage double")
    got = {(r["threshold_value"], r["breach_count"], r["total_samples"]) for r in mx.backtest(series, slo, "2024-01-02", 30).collect()}
    assert got == {(5.0, 5, 10), (8.0, 2, 10)} and mx.backtest(series, slo, "2024-01-02", 30).count() == 2


def test_events_far_apart(spark):
    rows = [("s", datetime(1970, 1, 1), True), ("s", datetime(2024, 1, 1), False), ("t", datetime(2024, 1, 1), True)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, ok boolean")
    at = int(datetime(2024, 1, 1).timestamp())
    w = mx.multi_window(df, ["s"], "ts", F.col("ok"), {"w15": 900}, between=(at - 600, at + 1200))
    got = sorted((r["s"], r["step"] - at, r["total"], r["w15"]) for r in w.collect())
    assert got == [(s, t, int(t == 0), (0 if s == "s" else 100) if 0 <= t < 900 else None) for s in "st" for t in range(-600, 1500, 300)]
    long = mx.multi_window(df, ["s"], "ts", F.col("ok"), {"w": 60 * 365 * 86400}, between=(at, at)).collect()
    assert {(r["s"], r["w"]) for r in long} == {("s", 50.0), ("t", 100.0)}


def sliding(samples, t, width):
    """The published rule for one series."""
    inside = [(at, v) for at, v in samples if t - width < at <= t]
    if len(inside) < 2:
        return None
    up = sum(b if b < a else b - a for (_, a), (_, b) in zip(inside, inside[1:]))
    (t0, v0), (t1, _) = inside[0], inside[-1]
    span, mean = t1 - t0, (t1 - t0) / (len(inside) - 1)
    head, tail = t0 - (t - width), t - t1
    head = mean / 2 if head >= mean * 1.1 else head
    if up > 0 and v0 >= 0:
        head = min(head, span * v0 / up)
    tail = mean / 2 if tail >= mean * 1.1 else tail
    return up * (span + head + tail) / span / width


@pytest.mark.parametrize("width,step", [(300, 60), (900, 300), (60, 300)])
def test_sliding_rate(spark, width, step):
    import random

    rng, series = random.Random(width), {}
    start = int(datetime(2024, 1, 1, 20).timestamp())
    for name in (None, "a", "b"):
        at, value, samples = start + rng.randrange(100), 0.0, []
        for _ in range(300):
            at += rng.choice([1, 7, 30, 30, 45, 60, 4000 if rng.random() < 0.05 else 60])
            value = float(rng.randrange(3)) if rng.random() < 0.1 else value + rng.randrange(5)  # resets, also at edges of ranges
            samples.append((at, value))
        series[name] = samples
    rows = [(name, datetime.fromtimestamp(at), v) for name, samples in series.items() for at, v in samples]
    df = spark.createDataFrame(rows, "s string, ts timestamp, value double").repartition(5)
    got = {(r["s"], r["step"]): r["rate"] for r in mx.sliding_rate(df, ["s"], ["s"], width, step).collect()}
    want = {}
    for name, samples in series.items():
        for t in range(samples[0][0] // step * step, samples[-1][0] + width + step, step):
            rate = sliding(samples, t, width)
            if rate is not None:
                want[(name, t)] = rate
    assert set(got) == set(want) and want and all(got[k] == pytest.approx(want[k]) for k in want)
    plain = mx.sliding_rate(df, ["s"], ["s"], width, step, edges=False).agg(F.sum("rate")).first()[0]
    assert plain <= sum(want.values()) + 1e-9
