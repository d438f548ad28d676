import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import journeys as jn
from tidegauge.operators import traces as tr
from tidegauge.schemas import SPAN


def span(trace, sid, parent=None, name="op", service="svc", ms=10.0, error=False):
    return (trace, sid, parent, name, service, float(ms), {"error": "true"} if error else {})


def frame(spark, rows):
    return spark.createDataFrame(rows, SPAN)


def walk(spark, rows):
    out = tr.breadth_first_order(frame(spark, rows)).orderBy("trace_id", "position").collect()
    return [(r["trace_id"], r["span_id"], r["depth"], r["position"]) for r in out]


def test_error_rate_and_threshold(spark):
    rows = []
    for i in range(20):
        rows += [span(f"t{i:02}", "1", None, "home", "web", 5), span(f"t{i:02}", "2", "1", "pay", "bank", 20, i < 5)]
    rows += [span("x1", "1", None, "rare", "web"), span("x2", "1", None, "rare", "web")]
    out = tr.discover_journeys(frame(spark, rows)).collect()
    assert len(out) == 1
    j = out[0]
    assert j["error_rate"] == 0.25
    assert (j["entry_point"], j["exit_point"], j["name"]) == ("web:home", "bank:pay", "home-to-pay")
    assert j["traffic_volume"] == 20 and len(j["sample_trace_ids"]) == 10
    assert j["avg_duration_ms"] == 25 and j["avg_root_ms"] == 5
    assert [(s["service_name"], s["duration_p50"], s["error_rate"]) for s in j["step_sequence"]] == [("bank", 20, 0.25), ("web", 5, 0)]
    assert tr.discover_journeys(frame(spark, rows), min_traffic_volume=100).count() == 0


def test_root_rules(spark):
    rows = [span("t", "9", None, "real"), span("t", "1", "9", "low")]
    assert tr.trace_summary(frame(spark, rows)).first()["entry_point"] == "svc:real"
    assert tr.trace_summary(frame(spark, rows), "span_id").first()["entry_point"] == "svc:low"


def test_edges_and_leaves(spark):
    rows = [span("t", "1", None, service="a"), span("t", "2", "1", service="b"), span("t", "3", "2", service="b"), span("u", "2", "1", service="z")]
    assert [(r["caller"], r["callee"], r["calls"]) for r in tr.dependency_edges(frame(spark, rows)).collect()] == [("a", "b", 1)]
    assert sorted((r["trace_id"], r["span_id"]) for r in tr.leaf_spans(frame(spark, rows)).collect()) == [("t", "3"), ("u", "2")]


def test_walk_orders_root_parent_child(spark):
    rows = [span("t", "003", "002"), span("t", "002", "001"), span("t", "001", None)]
    assert walk(spark, rows) == [("t", "001", 0, 1), ("t", "002", 1, 2), ("t", "003", 2, 3)]


def test_walk_of_deep_wide_and_broken_traces(spark):
    rng = random.Random(3)
    rows = [span("deep", f"{i:03}", f"{i - 1:03}" if i else None) for i in range(70)]
    rows += [span("wide", "000", None)] + [span("wide", f"{i:03}", "000") for i in range(1, 200)]
    rows += [span("tree", "000", None)] + [span("tree", f"{i:03}", f"{rng.randrange(i):03}") for i in range(1, 300)]
    rows += [span("cut", "1", None), span("cut", "2", "gone"), span("cut", "3", "2")]
    rows += [span("rootless", "a", "z"), span("rootless", "b", "a")]
    children = {}
    roots = {}
    for t, s, p, *_ in rows:
        if p is None:
            roots[t] = s
        else:
            children.setdefault((t, p), []).append(s)
    want = [("rootless", "a", 0, 1), ("rootless", "b", 0, 2)]
    for t, r in roots.items():
        queue, n = [(r, 0)], 0
        while queue:
            s, depth = queue.pop(0)
            n += 1
            want.append((t, s, depth, n))
            queue += [(c, depth + 1) for c in sorted(children.get((t, s), []))]
    assert sorted(walk(spark, rows)) == sorted(want)


def test_ranking_and_spread(spark):
    step = "array<struct<span_name:string,service_name:string,duration_p50:double,error_rate:double>>"
    rows = [
        ("a", 1000, 0.0, 10.0, ["x"] * 10, [("s", "v", 10.0, 0.0), ("t", "v", 30.0, 0.0)]),
        ("b", 10, 0.9, 10.0, ["x"], [("s", "v", 10.0, 0.0)]),
    ]
    df = spark.createDataFrame(rows, f"entry_point string, traffic_volume long, error_rate double, avg_duration_ms double, sample_trace_ids array<string>, step_sequence {step}")
    out = {r["entry_point"]: r for r in tr.rank_journeys(df).collect()}
    assert out["a"]["latency_variance"] == 10 and out["b"]["latency_variance"] == 0
    assert out["a"]["business_impact_score"] == pytest.approx(70)
    assert out["b"]["business_impact_score"] == pytest.approx((0.01 * 0.4 + 0.9 * 0.3) * 100)
    assert (out["a"]["rank"], out["b"]["rank"]) == (1, 2)
    assert out["a"]["confidence_score"] == pytest.approx(30 + 10 + 4)
    assert tr.top_journeys(tr.rank_journeys(df), 5, 40.0).count() == 1
    per_group = tr.rank_journeys(df.withColumn("g", F.col("entry_point")), group=["g"])
    assert {r["rank"] for r in per_group.collect()} == {1}


def test_many_traces_give_confidence(spark):
    from tidegauge.functions.scoring import journey_confidence

    # 1,500 traces, ten samples, fifteen steps
    assert spark.range(1).select(journey_confidence(F.lit(1500), F.lit(10), F.lit(15))).first()[0] > 60


def test_decay_once_per_run_date(spark):
    df = spark.createDataFrame([("old", 80.0, "2024-01-01"), ("new", 80.0, "2024-01-30")], "name string, confidence_score double, d string")
    df = df.withColumn("last_seen_at", F.col("d").cast("timestamp"))
    once = jn.decay_stale(df, "2024-01-31")
    twice = jn.decay_stale(once, "2024-01-31")
    later = jn.decay_stale(twice, "2024-02-01")
    get = lambda x: {r["name"]: r["confidence_score"] for r in x.collect()}
    assert get(once) == get(twice) == {"old": 40.0, "new": 80.0}
    assert get(later) == {"old": 20.0, "new": 80.0}


def test_walk_with_cycles_self_parents_and_repeats(spark):
    rows = [span("t", "0", None), span("t", "1", "0"), span("t", "x", "y"), span("t", "y", "x"), span("t", "z", "x"), span("t", "s", "s")]
    assert sorted(walk(spark, rows)) == [("t", "0", 0, 1), ("t", "1", 1, 2)]
    chain = [span("c", f"{i:04}", f"{i - 1:04}" if i else None) for i in range(9)]
    assert sorted(walk(spark, chain * 2)) == [("c", f"{i:04}", i, i + 1) for i in range(9)]


def test_walk_of_a_deep_chain(spark):
    chain = [span("c", f"{i:04}", f"{i - 1:04}" if i else None) for i in range(1000)]
    assert sorted(walk(spark, chain))[-1] == ("c", "0999", 999, 1000)


def test_walk_is_cut_into_small_tasks(spark, monkeypatch):
    """span rows shrink many times when shuffled; tasks of the default size sorted gigabytes."""
    from pyspark.sql import DataFrameWriter

    key, seen, write = "spark.sql.adaptive.advisoryPartitionSizeInBytes", [], DataFrameWriter.parquet
    before = spark.conf.get(key)

    def recorded(self, path, *rest, **more):
        if "/walk-" in path:
            seen.append(spark.conf.get(key))
        return write(self, path, *rest, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    rows = [span("t", "a"), span("t", "b", "a"), span("t", "c", "b"), span("t", "d", "a")]
    assert walk(spark, rows) == [("t", "a", 0, 1), ("t", "b", 1, 2), ("t", "d", 1, 3), ("t", "c", 2, 4)]
    assert len(seen) > 1 and set(seen) == {"8m"} != {before}
    assert spark.conf.get(key) == before
