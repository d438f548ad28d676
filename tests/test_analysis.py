from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import analysis as an
from tidegauge.operators.evidence import indicator_candidates
from tidegauge.operators.metrics import histogram, histogram_quantile

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def requests(spark):
    rows = [("api", "/pay", T0 + timedelta(seconds=7 * i), (i % 40) / 10, ["200", "201", "503", "500", "404"][i % 5]) for i in range(400)]
    rows += [("api", "/slow", T0, 99.0, "200"), ("api", "/none", T0, None, None), ("db", "/pay", T0, 0.5, "500")]
    return spark.createDataFrame(rows, "job string, endpoint string, ts timestamp, seconds double, status string")


def candidates(spark, *entries):
    journeys = spark.createDataFrame([(f"j{i}", e) for i, e in enumerate(entries)], "name string, entry_point string")
    found = indicator_candidates(journeys, F.lit("api"))
    return found.withColumns({"service_name": F.lit("api"), "sli_id": F.concat_ws("|", "entry_point", "sli_name")})


def test_values_agree_with_the_plain_operators(spark, requests):
    bounds = [0.5, 1.0, 2.0]
    got = {(r["sli_id"].split("-", 1)[1], r["step"]): r["value"] for r in an.indicator_values(candidates(spark, "/pay"), an.request_series(requests, 300, bounds)).collect()}
    mine = requests.filter("job = 'api' AND endpoint = '/pay'").withColumn("step", F.floor(F.unix_seconds("ts") / 300) * 300)
    for p in (50, 95, 99):
        want = histogram_quantile(histogram(mine, ["step"], "seconds", bounds), ["step"], p / 100).collect()
        assert len(want) > 5 and all(got[(f"latency-p{p}", r["step"])] == pytest.approx(r["quantile"] * 1000) for r in want)
    for r in mine.groupBy("step").agg((F.count_if(F.col("status").startswith("5")) / F.count(F.lit(1)) * 100).alias("bad")).collect():
        assert got[("error-rate", r["step"])] == pytest.approx(r["bad"])
        assert got[("availability", r["step"])] == pytest.approx(100 - r["bad"])


def test_open_bucket_missing_values_and_unknown_endpoints(spark, requests):
    rows = an.indicator_values(candidates(spark, "/slow", "/none", "/unknown"), an.request_series(requests, 300, [0.5, 1.0])).collect()
    got = {(r["sli_id"].split("|")[0], r["sli_id"].split("-", 1)[1]): r["value"] for r in rows}
    assert got[("/slow", "latency-p99")] == 1000.0 and got[("/slow", "availability")] == 100.0  # the last finite bound
    assert got[("/none", "latency-p50")] is None and got[("/none", "error-rate")] == 0.0
    assert not any(e == "/unknown" for e, _ in got)


def test_other_patterns(spark, requests):
    odd = candidates(spark, "/pay").filter("metric_type = 'error_rate'").withColumn("status_pattern", F.lit("4..|503"))
    total = an.indicator_values(odd, an.request_series(requests, 86400)).first()["value"]
    assert total == pytest.approx(40.0)
