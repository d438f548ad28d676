import pytest
from pyspark.sql import functions as F

from tidegauge.functions import naming, scoring


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("n,score", [(50, 15), (100, 30), (1000, 70), (10000, 95), (20000, 100), (0, 0)])
def test_sample_size_score(spark, n, score):
    assert value(spark, scoring.sample_size_score(F.lit(n))) == pytest.approx(score)


def test_penalised_scores(spark):
    assert value(spark, scoring.coverage_score(F.lit(40.0))) == pytest.approx(32)
    assert value(spark, scoring.coverage_score(F.lit(80.0))) == pytest.approx(80)
    assert value(spark, scoring.completeness_score(F.lit(70.0))) == pytest.approx(49)
    assert value(spark, scoring.completeness_score(F.lit(90.0))) == pytest.approx(90)


def test_adjustments_in_order(spark):
    args = [F.lit(x) for x in (80.0, 50, 3, 5.0, 95.0, 95.0)]
    assert value(spark, scoring.adjusted_confidence(*args)) == pytest.approx(80 * 0.5 * 0.8 * 0.9)
    args = [F.lit(x) for x in (95.0, 20000, 30, 50.0, 95.0, 95.0)]
    assert value(spark, scoring.adjusted_confidence(*args)) == 100.0


def test_uplift_is_never_negative(spark):
    zero = [F.lit(x) for x in (500, 90.0, 90.0, 0.0, 0.0)]
    assert value(spark, scoring.confidence_uplift(*zero)) == 0
    gain = [F.lit(x) for x in (500, 40.0, 70.0, 20.0, 15.0)]
    assert value(spark, scoring.confidence_uplift(*gain)) == pytest.approx((60 - 32) * 0.3 + (85 - 49) * 0.3)


def test_thresholds(spark):
    for op, expected in {"lt": False, "lte": True, "gt": False, "gte": True, "eq": True, "odd": False}.items():
        assert value(spark, scoring.breaches(F.lit(5.0), F.lit(op), F.lit(5.0))) is expected


def test_durations(spark):
    for text, seconds in {"30d": 2592000, "24h": 86400, "90m": 5400, "7s": 7, "5w": None, "d": None, "-1d": None}.items():
        assert value(spark, naming.duration_seconds(F.lit(text))) == seconds
    for seconds, text in {2592000: "30d", 3600: "1h", 5400: "90m", 61: "61s"}.items():
        assert value(spark, naming.duration_text(F.lit(seconds))) == text


def test_names(spark):
    assert value(spark, naming.journey_name(F.lit("web:GET_/cart"), F.lit("db:write_row"))) == "get--cart-to-write-row"
    assert value(spark, naming.alert_name(F.lit("checkout_api"), F.lit("latency-p95"), F.lit("critical"))) == "CheckoutApiLatencyP95Critical"
    assert value(spark, naming.recording_rule_name(F.lit("a-b.c"), F.lit("x-y"))) == "a_b_c:x_y:recording"
    assert value(spark, naming.service_of_entry(F.lit("/api/checkout"))) == "api"
    assert value(spark, naming.metric_kind(F.lit("Error-availability"))) == "errors"
    assert value(spark, naming.latency_expression(F.lit("s"), F.lit("/e"), 0.95)) == (
        'histogram_quantile(0.95, sum by (le) (rate(http_request_duration_seconds_bucket{job="s", endpoint="/e"}[5m]))) * 1000'
    )


def test_saturation(spark):
    assert value(spark, scoring.queue_saturation(F.lit(500))) == 50
    assert value(spark, scoring.pool_use(F.lit(0), F.lit(0))) is None
    assert value(spark, scoring.budget_simulation(F.lit(99.0), F.lit(0.4))) == pytest.approx(0.6)
    assert value(spark, scoring.budget_rule(F.lit(99.5), F.lit(99.0))) == pytest.approx(50)
