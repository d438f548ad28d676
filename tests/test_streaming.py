import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import capsules as cp
from tidegauge.plans.streams import LetterEmbedder
from tidegauge.schemas import EMBEDDING, TELEMETRY
from tidegauge.session import workspace
from tidegauge.sources import ingest, stores
from tidegauge.streaming import jobs, sinks

T0 = datetime(2024, 1, 1)
ONCE = {"availableNow": True}


def event(i, minutes, message="hello", severity="INFO"):
    return (str(i), "svc", "prod", "log", T0 + timedelta(minutes=minutes), severity, message, None, None, {}, None)


def land(spark, path, batches):
    """One file per batch, with rising file times so that they are read in order."""
    for n, rows in enumerate(batches):
        part = f"{path}/part-{n}"
        spark.createDataFrame(rows, TELEMETRY).coalesce(1).write.parquet(part)
        for f in os.listdir(part):
            os.utime(f"{part}/{f}", (1700000000 + n, 1700000000 + n))


def source(spark, path):
    return spark.readStream.schema(TELEMETRY).option("maxFilesPerTrigger", 1).parquet(f"{path}/part-*")


def run(spark, path, dirs=None, ck=None, salts=jobs.SALTS):
    dirs = dirs or [workspace(spark, p) for p in ("capsules", "running")]
    ck = ck or [workspace(spark, "ck"), workspace(spark, "ck")]
    jobs.start_capsules(source(spark, path), dirs[0], ck[0], ONCE, salts=salts).awaitTermination()
    jobs.start_totals(source(spark, path), dirs[1], ck[1], ONCE).awaitTermination()
    return dirs, ck


def capsules(spark, dirs):
    rows = jobs.read_capsules(spark, dirs[0]).collect()
    out = {(r["template"], r["time_bucket"]): (r["count"], r["sample_event_ids"], r["severity"], r["severity_distribution"]) for r in rows}
    # the stateful job agrees
    running = {(r["template"], r["time_bucket"]): (r["count"], r["severity"]) for r in jobs.read_totals(spark, dirs[1]).collect()}
    assert running == {k: (v[0], v[2]) for k, v in out.items()}
    return out


def test_late_rows_inside_and_outside_the_bound(spark):
    path = workspace(spark, "late")
    batches = [
        [event(1, 30), event(2, 35, severity="ERROR")],
        [event(3, 75)],                     # newest event 01:15, watermark 00:55
        [event(4, 40)],                     # hour 00 still open: counts
        [event(5, 85)],                     # newest event 01:25, watermark 01:05
        [event(6, 50), event(7, 90)],       # hour 00 is closed: 6 is dropped
    ]
    land(spark, path, batches)
    dirs, ck = run(spark, path)
    got = capsules(spark, dirs)
    kept = [r for b in batches for r in b if r[0] != "6"]
    want = {
        (r["template"], r["time_bucket"]): (r["count"], r["sample_event_ids"], r["severity"], r["severity_distribution"])
        for r in cp.build_capsules(spark.createDataFrame(kept, TELEMETRY)).collect()
    }
    assert got == want
    assert got[("hello", T0)][0] == 3
    # started again without new files, nothing changes
    run(spark, path, dirs, ck)
    assert capsules(spark, dirs) == got
    # more rows arrive: the full new total is emitted
    land(spark, path + "x", [[event(8, 95)]])
    os.rename(f"{path}x/part-0", f"{path}/part-9")
    run(spark, path, dirs, ck)
    assert capsules(spark, dirs)[("hello", T0 + timedelta(hours=1))][0] == 4


def test_stream_equals_batch_over_many_batches(spark):
    path = workspace(spark, "many")
    rows = [event(i, i // 4, "hot" if i % 3 else f"rare {'ab'[i % 2]}", ["INFO", "WARN", "ERROR"][i % 3]) for i in range(900)]
    land(spark, path, [rows[:300], rows[300:600], rows[600:]])
    got = capsules(spark, run(spark, path)[0])
    want = {
        (r["template"], r["time_bucket"]): (r["count"], r["sample_event_ids"], r["severity"], r["severity_distribution"])
        for r in cp.build_capsules(spark.createDataFrame(rows, TELEMETRY)).collect()
    }
    assert got == want


def test_one_part_and_many_parts_agree(spark):
    path = workspace(spark, "salts")
    rows = [event(i, i // 40, "hot") for i in range(400)]
    land(spark, path, [rows[:200], rows[200:]])
    few, many = (capsules(spark, run(spark, path, salts=n)[0]) for n in (1, 7))
    assert few == many and few[("hot", T0)][0] == 400 and len(few[("hot", T0)][1]) == 10


def test_replayed_batch_leaves_the_same_data(spark):
    path = workspace(spark, "t")
    write = sinks.upsert_writer(path, ["id"], "at")
    df = spark.range(50).withColumn("at", F.lit(T0).cast("timestamp"))
    write(df.withColumn("n", F.lit(1)), 0)
    write(df.withColumn("n", F.lit(2)), 1)
    write(df.withColumn("n", F.lit(1)), 0)  # replayed: the table has seen it
    write(df.withColumn("n", F.lit(3)).limit(0), 2)
    assert {(r["n"], r["c"]) for r in stores.read_table(spark, path).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()} == {(2, 50)}


def test_session_settings_come_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with jobs.state_settings(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key, None) == before


def test_state_of_closed_hours_is_dropped(spark):
    path = workspace(spark, "closed")
    land(spark, path, [[event(1, 5)], [event(2, 200)], [event(3, 205)]])
    ck, dirs = [workspace(spark, "ck"), workspace(spark, "ck")], None
    dirs, _ = run(spark, path, dirs, ck, salts=1)
    state = spark.read.format("statestore").option("stateVarName", "capsule").load(ck[0])
    assert [r.key.bucket for r in state.select("key").collect()] == [int((T0 + timedelta(hours=3)).timestamp())]
    assert {k[1] for k in capsules(spark, dirs)} == {T0, T0 + timedelta(hours=3)}


def test_decoding(spark):
    values = ['{"event_id":"1","timestamp":"2024-01-01T00:00:00.123456Z","attributes":{"a":"b"},"other":1}', "not json", "", "[]", "5", "null",
              '{"event_id":"2","timestamp":"soon"}', '{"event_id":"3"', None, " {}"]
    df = spark.createDataFrame([(v,) for v in values], "value string").select(F.col("value").cast("binary").alias("value"))
    good, dead = jobs.decoded(df)
    rows = sorted(((r.event_id, r.timestamp, r.attributes) for r in good.collect()), key=str)
    assert rows == [("1", datetime(2024, 1, 1, 0, 0, 0, 123456), {"a": "b"}), (None, None, None)]
    assert sorted((bytes(r.value).decode() if r.value is not None else "~") for r in dead.collect()) == sorted("~" if v is None else v for v in values[1:-1])


def test_oversize_blobs_come_back(spark):
    rows, blobs, dead = (workspace(spark, p) for p in "rbd")
    write = sinks.oversize_writer(rows, blobs, dead, 11)
    df = spark.createDataFrame([event(1, 1, "x" * 20), event(2, 2, "short"), event(3, 3, "é" * 6), event(4, 4, "y" * 30, "LOUD")], TELEMETRY)
    for _ in range(2):
        write(df, 0)
    stored, moved = jobs.read_batches(spark, rows), jobs.read_batches(spark, blobs)
    assert {r.event_id: r.message for r in stored.collect()} == {"1": None, "2": "short", "3": None} and moved.count() == 2
    assert {r.event_id: r.message for r in ingest.with_blobs(stored, moved).collect()} == {"1": "x" * 20, "2": "short", "3": "é" * 6}
    assert jobs.read_batches(spark, dead).count() == 1


def test_split_writer(spark):
    good, dead = workspace(spark, "g"), workspace(spark, "d")
    rows = [event(1, 1), event(2, 2, severity="LOUD")]
    write = sinks.split_writer(good, dead)
    write(spark.createDataFrame(rows, TELEMETRY), 0)
    write(spark.createDataFrame(rows, TELEMETRY), 0)
    assert spark.read.parquet(good).count() == 1
    assert [r["reason"] for r in spark.read.parquet(dead).collect()] == ["bad severity"]


def test_failed_store_uses_the_fallback(spark):
    fallback = workspace(spark, "fallback")

    def broken(df, batch_id):
        raise RuntimeError("store is down")

    sinks.with_fallback(broken, sinks.batch_writer(fallback))(spark.range(3), 0)
    rows = spark.read.parquet(fallback).collect()
    assert len(rows) == 3 and {r["error"] for r in rows} == {"store is down"}


@pytest.mark.parametrize("n", [1, 100, 250])
def test_embedding_batches_and_gate(spark, n):
    path = workspace(spark, "capsules")
    df = spark.range(n).select(F.concat(F.lit("pattern "), F.col("id").cast("string")).alias("template"), (F.col("id") % 2 == 0).alias("redaction_applied"))
    df.write.parquet(path)
    sizes = workspace(spark, "sizes")
    os.makedirs(sizes)

    class Counting(LetterEmbedder):
        def embed(self, texts):
            assert 0 < len(texts) <= 100
            return super().embed(texts)

    dirs = [workspace(spark, p) for p in ("v", "f", "r")]
    stream = spark.readStream.schema(df.schema).parquet(path)
    jobs.start_embeddings(stream, Counting(), *dirs, workspace(spark, "ck"), ONCE).awaitTermination()
    vectors = stores.read_vectors(spark, dirs[0])
    assert vectors.count() == (n + 1) // 2 and set(vectors.columns) == {*EMBEDDING.names, "environment"}
    assert np.linalg.norm(vectors.first()["embedding_vector"]) == pytest.approx(1, abs=1e-5)
    assert {r["embedding_model"] for r in vectors.collect()} == {"letters"}
    assert spark.read.parquet(dirs[2]).count() == n // 2
    assert jobs.read_batches(spark, dirs[1]) is None


def test_small_capsules_share_state(spark):
    """a call to the state for every capsule took longer than all of its rows."""
    path = workspace(spark, "small")
    words = ["".join("abcdefghij"[int(c)] for c in str(i)) for i in range(300)]
    rows = [event(i, i % 60, w) for i, w in enumerate(words)]
    land(spark, path, [rows[:200], rows[100:]])
    ck, out = workspace(spark, "ck"), workspace(spark, "capsules")
    jobs.start_capsules(source(spark, path), out, ck, ONCE, salts=1).awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "capsule").load(ck)
    assert 1 < held.count() <= jobs.SHARES
    assert {r["template"]: r["count"] for r in jobs.read_capsules(spark, out).collect()} == {
        w: 2 if 100 <= i < 200 else 1 for i, w in enumerate(words)}


def test_rows_without_a_blob_are_not_one_group(spark):
    """rows that never moved have no key, and met the blobs in one task."""
    rows = spark.range(4000).repartition(8).select(
        F.col("id").cast("string").alias("event_id"), F.when(F.col("id") >= 100, "small").alias("message"),
        F.when(F.col("id") < 100, F.concat(F.lit("raw/"), F.col("id").cast("string"))).alias("raw_blob_s3_key"))
    blobs = spark.range(100).select(F.concat(F.lit("raw/"), F.col("id").cast("string")).alias("key"), F.lit("large").alias("message"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ingest.with_blobs(rows, blobs).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(out) == 4000 and all(r["message"] == ("large" if int(r["event_id"]) < 100 else "small") for r in out)
    parts = [r["part"] for r in out]
    assert max(parts.count(p) for p in set(parts)) <= 1000
