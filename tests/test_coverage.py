import random
from datetime import datetime, timedelta

import pytest

from tidegauge.operators import journeys as jn

T0 = datetime(2024, 1, 1)


def test_coverage_matches_brute_force(spark):
    rng = random.Random(2)
    caps = [(f"s{0 if i % 3 == 0 else rng.randrange(4)}", T0 + timedelta(hours=rng.randrange(60))) for i in range(400)]
    js = []
    for i in range(120):
        a = T0 + timedelta(minutes=rng.randrange(-600, 4600))
        js.append((i, f"s{rng.randrange(6)}", a, a + timedelta(minutes=rng.randrange(0, 3000))))
    got = {r["journey_id"]: r for r in jn.capsule_coverage(
        spark.createDataFrame(js, "journey_id int, service_name string, discovered_at timestamp, last_seen_at timestamp"),
        spark.createDataFrame(caps, "service_name string, time_bucket timestamp")).collect()}
    assert len(got) == len(js)
    for i, s, a, b in js:
        inside = [t for name, t in caps if name == s and a <= t <= b]
        hours = max(1, (b - a).total_seconds() / 3600)
        assert (got[i]["capsules"], got[i]["hours"]) == (len(inside), len(set(inside)))
        assert got[i]["coverage_pct"] == pytest.approx(min(100, len(inside) / hours * 100))


def test_merge_keeps_steps_and_adds_new(spark):
    cols = "service_id int, name string, steps string, traffic_volume_per_day int, confidence_score double, sample_trace_ids array<string>"
    old = spark.createDataFrame([(1, "a", "old", 5, 50.0, ["x"], T0, T0), (1, "b", "old", 5, 50.0, ["x"], T0, T0)], cols + ", discovered_at timestamp, last_seen_at timestamp")
    new = spark.createDataFrame([(1, "a", "new", 9, 90.0, ["y"]), (2, "c", "new", 1, 10.0, ["z"])], cols)
    got = {r["name"]: r for r in jn.merge_journeys(old, new, "2024-02-01").collect()}
    now = datetime(2024, 2, 1)
    assert (got["a"]["steps"], got["a"]["traffic_volume_per_day"], got["a"]["last_seen_at"], got["a"]["discovered_at"]) == ("old", 9, now, T0)
    assert (got["b"]["confidence_score"], got["b"]["last_seen_at"]) == (50.0, T0)
    assert (got["c"]["steps"], got["c"]["discovered_at"], got["c"]["last_seen_at"]) == ("new", now, now)
