import hashlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegauge.operators import capsules as cp
from tidegauge.schemas import TELEMETRY

T0 = datetime(2024, 1, 1)


def event(i, message="hello", service="a", minutes=0, severity="INFO", **kw):
    base = dict(event_id=str(i), service_name=service, environment="prod", event_type="log", timestamp=T0 + timedelta(minutes=minutes),
                severity=severity, message=message, trace_id=None, span_id=None, attributes={}, raw_blob_s3_key=None)
    return {**base, **kw}


def frame(spark, rows):
    return spark.createDataFrame(rows, TELEMETRY)


def test_hundred_events_give_ten_distinct_samples(spark):
    caps = cp.build_capsules(frame(spark, [event(i) for i in range(100)])).collect()
    assert len(caps) == 1
    ids = caps[0]["sample_event_ids"]
    want = sorted(map(str, range(100)), key=lambda e: hashlib.md5(e.encode()).hexdigest())[:10]
    assert ids == want
    assert caps[0]["count"] == 100


def test_hot_template_matches_brute_force(spark):
    rows = [event(i, "hot" if i % 3 else f"rare pattern{'x' * (i % 7)}", f"s{i % 2}", i % 180, ["INFO", "ERROR", "WARN"][i % 3]) for i in range(3000)]
    got = {(r["template"], r["service_name"], r["time_bucket"]): r for r in cp.build_capsules(frame(spark, rows), stage=True).collect()}
    groups = {}
    for r in rows:
        groups.setdefault((r["message"], r["service_name"], r["timestamp"].replace(minute=0)), []).append(r)
    assert set(got) == set(groups)
    for key, members in groups.items():
        row = got[key]
        assert row["count"] == len(members)
        assert row["first_seen_at"] == min(m["timestamp"] for m in members)
        assert row["last_seen_at"] == max(m["timestamp"] for m in members)
        by = {}
        for m in members:
            by[m["severity"]] = by.get(m["severity"], 0) + 1
        assert row["severity_distribution"] == by
        best = sorted((m["event_id"] for m in members), key=lambda e: hashlib.md5(e.encode()).hexdigest())[:10]
        assert row["sample_event_ids"] == best


def test_primary_severity_breaks_ties_by_rank(spark):
    rows = [event(1, severity="INFO"), event(2, severity="ERROR"), event(3, severity=None)]
    cap = cp.build_capsules(frame(spark, rows)).first()
    assert cap["severity"] == "ERROR"
    assert cap["severity_distribution"] == {"INFO": 1, "ERROR": 1}
    assert cap["count"] == 3


def test_service_and_hour_separate_capsules(spark):
    rows = [event(1), event(2, service="b"), event(3, minutes=61)]
    assert cp.build_capsules(frame(spark, rows)).count() == 3


def test_dead_letters_keep_the_original(spark):
    rows = [event(1), event(None), event(3, service=None), event(4, environment="qa"), event(5, severity="LOUD"), event(6, timestamp=None)]
    rows[1]["event_id"] = None
    good, dead = cp.split_valid(frame(spark, rows), F.lit("2024-02-01").cast("timestamp"))
    assert good.count() == 1
    reasons = sorted(r["reason"] for r in dead.collect())
    assert reasons == ["bad environment", "bad severity", "missing event_id", "missing service_name", "missing timestamp"]
    assert all("message" in r["original"] for r in dead.collect())


def test_gate_and_latest(spark):
    caps = spark.createDataFrame([(str(i), "s", T0 + timedelta(hours=i), i % 2 == 0) for i in range(4)],
                                 "fingerprint_hash string, service_name string, time_bucket timestamp, redaction_checked boolean")
    ok, refused = cp.ready_for_embedding(caps)
    assert ok.count() == refused.count() == 2
    same = caps.withColumn("fingerprint_hash", F.lit("f"))
    assert [r["time_bucket"].hour for r in cp.latest_capsules(same, 2).orderBy("recency").collect()] == [3, 2]
