from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.session import workspace
from tidegauge.sources import ingest, stores
from tidegauge.sources.versions import VersionedTable
from tidegauge.schemas import METRIC_SAMPLE, TRACE_EXPORT

T0 = datetime(2024, 1, 1)
KEYS = ["f", "s", "b"]


def caps(spark, rows):
    return spark.createDataFrame([(f, s, T0 + timedelta(hours=h), n) for f, s, h, n in rows], "f string, s string, b timestamp, n long")


def content(spark, path):
    return sorted((r["f"], r["s"], r["b"], r["n"]) for r in stores.read_table(spark, path).collect())


def test_same_key_updates_other_bucket_inserts(spark):
    path = workspace(spark, "u")
    stores.upsert(path, caps(spark, [("x", "a", 0, 1), ("y", "a", 0, 7), ("z", "a", 30, 9)]), KEYS, "b")
    stores.upsert(path, caps(spark, [("x", "a", 0, 2), ("x", "a", 1, 3)]), KEYS, "b")
    want = [("x", "a", T0, 2), ("x", "a", T0 + timedelta(hours=1), 3), ("y", "a", T0, 7), ("z", "a", T0 + timedelta(hours=30), 9)]
    assert content(spark, path) == want
    stores.upsert(path, caps(spark, [("x", "a", 0, 2), ("x", "a", 1, 3)]), KEYS, "b")
    assert content(spark, path) == want


def test_newest_of_one_change_set_wins(spark):
    path = workspace(spark, "u")
    stores.upsert(path, caps(spark, [("x", "a", 0, 1), ("x", "a", 0, 5), ("x", "a", 0, 3)]), KEYS, "b", newest="n")
    assert content(spark, path) == [("x", "a", T0, 5)]


def test_retention_drops_whole_days(spark):
    path = workspace(spark, "r")
    stores.upsert(path, caps(spark, [("x", "a", 24 * d, d) for d in range(5)]), KEYS, "b")
    gone = stores.drop_expired(path, spark, "2024-01-04", 1)
    assert gone == ["2024-01-01", "2024-01-02"]
    assert [r[3] for r in content(spark, path)] == [2, 3, 4]
    assert stores.unexpired(caps(spark, [("x", "a", 0, 1), ("x", "a", 72, 1)]), "b", "2024-01-04", 1).count() == 1


def test_compaction_keeps_rows(spark):
    path = workspace(spark, "c")
    stores.upsert(path, caps(spark, [(str(i), "ab"[i % 2], i % 72, i) for i in range(200)]), KEYS, "b")
    before = content(spark, path)
    assert stores.compact(path, spark, "2024-01-10", 7, "s", "b") == ["2024-01-01", "2024-01-02"]
    assert content(spark, path) == before
    assert stores.compact(path, spark, "2024-01-10", 7, "s", "b") == []  # once is enough
    files = [f for f in stores.read_table(spark, path).inputFiles() if "2024-01-03" not in f]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    stores.upsert(path, caps(spark, [("0", "a", 0, 99)]), KEYS, "b")
    assert stores.compact(path, spark, "2024-01-10", 7, "s", "b") == ["2024-01-01"] and ("0", "a", T0, 99) in content(spark, path)


def sample_rows(spark, n):
    return spark.createDataFrame(
        [("ab" * 32, "s", T0, [{"event_id": str(i)} for i in range(n)]), ("cd" * 32, "s", T0 + timedelta(days=1), [{"event_id": "z"}])],
        "fingerprint_hash string, service_name string, time_bucket timestamp, sample_array array<map<string,string>>",
    )


def test_sample_files_by_key_and_day(spark):
    path = workspace(spark, "s")
    stores.write_samples(sample_rows(spark, 10), path)
    assert stores.read_samples(spark, path, fingerprint="ab" * 32).count() == 10
    assert [r["sample"] for r in stores.read_samples(spark, path, day="2024-01-02").collect()] == [{"event_id": "z"}]


def test_too_many_samples_fail(spark):
    with pytest.raises(Exception, match="too many samples: 11"):
        stores.write_samples(sample_rows(spark, 11), workspace(spark, "s"))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "capsule_id string, environment string, service_name string, time_bucket timestamp")


def test_vector_delete(spark):
    path = workspace(spark, "v")
    v = vectors(spark, [("1", "prod", "a", T0), ("2", "dev", "a", T0), ("3", "prod", "b", T0)])
    for _ in range(2):  # a replayed insert leaves the same rows
        stores.insert_vectors(v, path, "w", 0)
    files = set(stores.read_vectors(spark, path).inputFiles())
    for _ in range(2):
        stores.delete_vectors(spark, path, spark.createDataFrame([("3",), ("9",)], "capsule_id string"), "w", 1)
    ids = lambda: sorted(r["capsule_id"] for r in stores.read_vectors(spark, path).collect())
    table = VersionedTable(spark, path, "environment")
    assert ids() == ["1", "2"] and {f for f in files} == data_files(spark, table)  # no data file was written
    stores.insert_vectors(v.filter("capsule_id = '3'"), path, "w", 2)  # inserted again after the delete
    assert ids() == ["1", "2", "3"] and table.record()["marks"]
    assert stores.compact_vectors(spark, path) == ["dev", "prod"]
    assert ids() == ["1", "2", "3"] and not table.record()["marks"] and stores.compact_vectors(spark, path) == []
    assert stores.collection_stats(stores.read_vectors(spark, path)).first()["num_entities"] == 3
    assert stores.table_stats(spark.read.parquet(*stores.read_vectors(spark, path).inputFiles()), "vectors").first()["row_count"] == 3


def data_files(spark, table):
    return {f for e in table.record()["live"].values() for x in e for f in spark.read.parquet(f"{table.path}/data/v={x['folder']}").inputFiles()}


class Stop(Exception):
    pass


@pytest.fixture
def stopping(monkeypatch):
    """Stops before the n-th write of any kind; returns the number of writes met."""
    state = {"left": None, "met": 0}

    def guard(name):
        real = getattr(VersionedTable, name)

        def guarded(self, *args, **kw):
            state["met"] += 1
            if state["left"] is not None:
                if state["left"] == 0:
                    raise Stop(name)
                state["left"] -= 1
            return real(self, *args, **kw)

        monkeypatch.setattr(VersionedTable, name, guarded)

    for name in ("_write", "_rename_new", "_hadoop"):
        guard(name)
    return state


@pytest.mark.parametrize("kind", ["upsert", "append", "delete", "compact"])
def test_stopped_between_any_two_writes(spark, stopping, kind):
    rows = caps(spark, [("x", "a", 0, 1), ("y", "a", 0, 7), ("z", "a", 30, 9)]).withColumn("day", F.to_date("b")).coalesce(1)
    more = caps(spark, [("x", "a", 0, 2), ("x", "a", 1, 3), ("w", "a", 80, 4)]).withColumn("day", F.to_date("b")).coalesce(1)
    change = {
        "upsert": lambda t: t.upsert(more, KEYS, None, "w", 1), "append": lambda t: t.append(more, "w", 1),
        "delete": lambda t: t.delete(rows.filter("f = 'x'").select(*KEYS), "w", 1), "compact": lambda t: t.compact("s", "b"),
    }[kind]

    def started():
        stopping["left"] = None
        table = VersionedTable(spark, workspace(spark, "crash"))
        table.append(rows, "w", 0)
        return table

    shown = lambda t: sorted(tuple(r) for r in t.read().collect())
    table = started()
    old = shown(table)
    stopping["met"] = 0
    change(table)
    steps, new = stopping["met"], shown(table)
    assert (old == new) == (kind == "compact") and steps > 3
    for step in range(0, steps, 2):
        table = started()
        stopping["left"] = step
        with pytest.raises(Stop):
            change(table)
        stopping["left"] = None
        assert shown(table) in (old, new)  # never a part of the change
        change(table)
        assert shown(table) == new
        change(table)
        assert shown(table) == new
        assert table.vacuum(older_than_hours=0) >= 0 and shown(table) == new


def test_two_writers(spark):
    """A writer whose partitions were changed meanwhile merges again; others do not wait for each other."""
    path = workspace(spark, "two")
    stores.upsert(path, caps(spark, [("x", "a", 0, 1)]), KEYS, "b")
    first = VersionedTable(spark, path)
    real, fired = first._write, []

    def slow(rows, **options):
        out = real(rows, **options)
        if not fired:
            fired.append(stores.upsert(path, caps(spark, [("y", "a", 0, 5), ("z", "a", 50, 6)]), KEYS, "b"))
        return out

    first._write = slow
    first.upsert(caps(spark, [("x", "a", 0, 2)]).withColumn("day", F.to_date("b")), KEYS)
    assert [(r[0], r[3]) for r in content(spark, path)] == [("x", 2), ("y", 5), ("z", 6)]
    assert first.versions() == [1, 2, 3] and [r["f"] for r in first.read(1).collect()] == ["x"]


def test_odd_partition_values(spark):
    table = VersionedTable(spark, workspace(spark, "odd"), "environment")
    rows = vectors(spark, [("1", "a b/c=d%", "s", T0), ("2", None, "s", T0), ("3", "", "s", T0)])
    table.upsert(rows, ["capsule_id"])
    table.upsert(vectors(spark, [("1", "a b/c=d%", "t", T0), ("2", None, "t", T0)]), ["capsule_id"])
    got = sorted((r["capsule_id"], r["environment"], r["service_name"]) for r in table.read().collect())
    assert got[:2] == [("1", "a b/c=d%", "t"), ("2", None, "t")] and got[2][2] == "s"


def test_policies(spark):
    last = date(2024, 6, 1)
    for kind, policy in stores.POLICIES.items():
        path = workspace(spark, kind)
        days = [last - timedelta(days=n) for n in range(0, 400, 10)]
        name = (lambda day: str(day)[:7]) if policy.partition == "month" else str
        rows = spark.createDataFrame([(name(day), day, "s", "i") for day in days], "p string, at date, service_name string, sli_id string")
        rows = rows.withColumnRenamed("p", policy.partition).withColumn("time_bucket", F.col("at").cast("timestamp")).withColumn("created_at", F.col("time_bucket"))
        VersionedTable(spark, path, policy.partition).append(rows.coalesce(1))
        done = stores.upkeep(spark, path, kind, str(last))
        edge = lambda n: name(last - timedelta(days=n))
        kept = sorted(r["at"] for r in stores.read_table(spark, path, policy.partition).collect())
        assert kept == sorted(day for day in days if name(day) >= edge(policy.retention))
        old = {name(day) for day in kept if policy.compaction is not None and name(day) < edge(policy.compaction)}
        assert set(done["rewritten"]) == old and done["dropped"]


def test_metric_samples(spark):
    df = spark.createDataFrame([("up", {"job": "api"}, T0, 1.5), ("cpu", {"job": "db", "environment": "dev"}, T0, 2.0)], METRIC_SAMPLE)
    rows = {r["service_name"]: r for r in ingest.metric_samples(df).collect()}
    assert rows["api"]["message"] == "up=1.500000" and rows["api"]["environment"] == "prod"
    assert rows["db"]["environment"] == "dev" and rows["db"]["attributes"] == {"metric_name": "cpu", "metric_value": "2.000000"}


def test_trace_export(spark):
    def resource(name, spans):
        attrs = [] if name is None else [("other", ("x",)), ("service.name", (name,))]
        return ((attrs,), [(spans,)])

    s = (bytes.fromhex("0aff"), bytes.fromhex("01"), "GET", "SERVER", 1704067200123999999)
    df = spark.createDataFrame([([resource("api", [s, s]), resource(None, [s])],)], TRACE_EXPORT)
    rows = ingest.trace_export(df).collect()
    assert sorted(r["service_name"] for r in rows) == ["api", "api", "unknown"]
    assert {(r["trace_id"], r["span_id"], r["timestamp"]) for r in rows} == {("0aff", "01", datetime(2024, 1, 1, 0, 0, 0, 123000))}


def test_log_batches(spark):
    bodies = ['[{"service":"a","message":"m","severity":"WARN"},{"service":5,"extra":"e"}]', "{not json", "[]"]
    df = spark.createDataFrame([(b, T0) for b in bodies], "body string, received_at timestamp")
    good, bad = ingest.log_batches(df)
    rows = sorted((r["service_name"], r["message"], r["severity"]) for r in good.collect())
    assert rows == [("a", "m", "WARN"), ("unknown", "", "INFO")]
    assert [r["reason"] for r in bad.collect()] == ["Invalid JSON"]
    assert len({r["event_id"] for r in good.collect()}) == 2


def test_oversize(spark):
    df = spark.createDataFrame([("1", "x" * 20), ("2", "é" * 6), ("3", None)], "event_id string, message string").withColumns(
        {"timestamp": F.lit(T0), "raw_blob_s3_key": F.lit(None).cast("string")})
    kept, blobs = ingest.split_oversize(df, 11)
    assert {r["event_id"]: r["raw_blob_s3_key"] for r in kept.collect()} == {"1": "raw/2024-01-01/1", "2": "raw/2024-01-01/2", "3": None}
    assert blobs.count() == 2
