import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import evidence as ev
from tidegauge.operators import index as ix
from tidegauge.operators import vectors as vc
from tidegauge.session import materialize, workspace

RNG = np.random.default_rng(11)
N, Q, D, K = 900, 37, 32, 5
CORPUS = RNG.normal(size=(N, D))
CORPUS[N // 2:] = CORPUS[: N - N // 2]  # exact copies
CORPUS /= np.linalg.norm(CORPUS, axis=1, keepdims=True)
QUERIES = RNG.normal(size=(Q, D))
QUERIES /= np.linalg.norm(QUERIES, axis=1, keepdims=True)
SERVICE = ["hot" if i % 3 == 0 else f"s{i % 5}" for i in range(N)]
HOUR = RNG.integers(0, 100, N)


@pytest.fixture(scope="module")
def tables(spark):
    v = spark.createDataFrame(
        [(f"{i:04}", SERVICE[i], int(HOUR[i]) * 3600, CORPUS[i].tolist()) for i in range(N)],
        "capsule_id string, service_name string, t long, vector array<double>",
    ).withColumn("time_bucket", F.timestamp_seconds("t")).repartition(7)
    q = spark.createDataFrame(
        [(f"q{j:02}", SERVICE[j], j * 3600, (j + 30) * 3600, QUERIES[j].tolist()) for j in range(Q)],
        "query_id string, service_name string, f long, u long, vector array<double>",
    ).withColumns({"time_from": F.timestamp_seconds("f"), "time_to": F.timestamp_seconds("u")})
    return v, q


def brute(allowed):
    out = {}
    for j in range(Q):
        scores = np.round(CORPUS @ QUERIES[j], 9)
        ids = [i for i in range(N) if allowed(i, j)]
        out[f"q{j:02}"] = [f"{i:04}" for i in sorted(ids, key=lambda i: (-scores[i], i))[:K]]
    return {k: v for k, v in out.items() if v}


def answer(df):
    out = {}
    for r in df.orderBy("query_id", "position").collect():
        out.setdefault(r["query_id"], []).append(r["capsule_id"])
    return out


@pytest.mark.parametrize("block", [2048, 5])
def test_exact_search_with_ties_and_blocks(tables, block):
    assert answer(vc.batch_search(*tables, K, block_size=block)) == brute(lambda i, j: True)


def test_search_within_service_and_time(tables):
    assert answer(vc.batch_search(*tables, K, same=("service_name",))) == brute(lambda i, j: SERVICE[i] == SERVICE[j])
    assert answer(vc.batch_search(*tables, K, timed=True)) == brute(lambda i, j: j <= HOUR[i] <= j + 30)


def test_single_query_agrees_with_batch(tables):
    v, q = tables
    one = [r["capsule_id"] for r in vc.search(v, QUERIES[4].tolist(), K, -1.0).orderBy(F.col("score").desc(), "capsule_id").collect()]
    assert one == brute(lambda i, j: True)["q04"]


def test_floor_applies_after_top_k(tables):
    hits = vc.batch_search(*tables, K)
    assert vc.above_floor(hits, 0.4).count() == hits.filter("score >= 0.4").count() < hits.count()


def test_related_leaves_itself_out(tables):
    v, _ = tables
    got = vc.related_capsules(v, v.filter("capsule_id = '0001'"), 3).collect()
    assert len(got) == 3 and all(r["capsule_id"] != "0001" for r in got)
    assert next(r for r in got if r["position"] == 1)["capsule_id"] == f"{N // 2 + 1:04}"  # its copy


def test_full_radius_is_exact_and_recall_grows(tables):
    v, q = tables
    truth = vc.batch_search(v, q, K)
    full = vc.approximate_search(v, q, K, radius=vc.SKETCH_BITS)
    assert answer(full) == answer(truth)
    mean = lambda r: vc.recall(vc.approximate_search(v, q, K, radius=r), truth).agg(F.avg("recall")).first()[0]
    low, high = mean(0), mean(3)
    assert low < high <= 1


def test_approximate_search_scores_probed_cells_only(tables):
    v, q = tables
    cell = lambda df, key: {r[key]: r["s"] for r in df.select(key, vc.sketch(F.col("vector")).alias("s")).collect()}
    rows, asked = cell(v, "capsule_id"), cell(q, "query_id")
    near = lambda i, j: (rows[f"{i:04}"] ^ asked[f"q{j:02}"]).bit_count() <= 2
    found = vc.approximate_search(v, q, K, radius=2)
    assert answer(found) == brute(near)
    asks = vc.probes(q, 2).withColumn("sketch", F.explode("sketch"))
    scored = asks.join(v.withColumn("sketch", vc.sketch(F.col("vector"))), "sketch").count()
    assert scored == sum(near(i, j) for i in range(N) for j in range(Q)) < N * Q / 2


def test_corpus_stays_where_it_is(spark, tables):
    """One exchange, of at most k rows a query and task, whatever the size of the corpus."""
    v, q = tables
    spread = lambda n: v.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(
        "capsule_id", F.concat_ws("-", "capsule_id", "n")).repartition(4)
    sizes = []
    for corpus in (spread(1), spread(20)):
        corpus = materialize(corpus.drop("n"), "corpus")
        found = vc.batch_search(corpus, q, K)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") in (1, 2)  # final and initial plan
        assert plan.index("Exchange hashpartitioning") < plan.index("MapInArrow") and "WindowGroupLimit" in plan
        sizes.append(moved(spark))
    assert sizes[1] <= sizes[0] * 1.5


def moved(spark):
    """Bytes written to shuffles by the last query."""
    import re

    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values = {m.accumulatorId(): m.name() for m in (last.metrics().apply(i) for i in range(last.metrics().size()))}
    found = store.executionMetrics(last.executionId())
    sizes = [found.apply(k) for k, name in values.items() if name == "shuffle bytes written" and found.contains(k)]
    unit = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20}
    return sum(float(a) * unit[u] for s in sizes for a, u in re.findall(r"([\d.]+) (B|KiB|MiB)", s)[:1])


def test_blocks_that_do_not_fit_in_memory(tables, monkeypatch):
    monkeypatch.setattr(vc, "HELD_NUMBERS", 100)
    assert answer(vc.batch_search(*tables, K, block_size=5)) == brute(lambda i, j: True)
    monkeypatch.setattr(vc, "HELD_HITS", 20)
    assert answer(vc.batch_search(*tables, K, block_size=5, same=("service_name",))) == brute(lambda i, j: SERVICE[i] == SERVICE[j])


def clustered(spark, n, groups, dims=24, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    rows = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.25
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return rows, spark.createDataFrame([(f"{i:06}", r.tolist()) for i, r in enumerate(rows)], "capsule_id string, vector array<double>").repartition(8)


def test_fitted_index(spark):
    rows, v = clustered(spark, 6000, 60)
    v = materialize(v, "vectors")
    index = ix.fit_index(v, workspace(spark, "index"), sample=1500)
    assert index.centres.shape == (78, 24) and ix.open_index(spark, index.path).probes == index.probes
    asked = v.where("capsule_id < '000300'").withColumnRenamed("capsule_id", "query_id")
    truth, found = vc.batch_search(v, asked, 10), ix.search_index(spark, index, asked, 10)
    share = ix.pairs_scored(spark, index, asked).agg(F.sum("scored") / F.sum("stored")).first()[0]
    recalls = [r.recall for r in vc.recall(found, truth).collect()]
    assert len(recalls) == 300 and np.mean(recalls) >= 0.9 and share < 0.25
    every = ix.search_index(spark, index, asked, 10, probes=78)
    assert answer(every) == answer(truth)  # all cells: the exact answer
    some = ix.search_index(spark, index, asked, 10, where=F.col("capsule_id") < "003000")
    assert some.filter("capsule_id >= '003000'").count() == 0
    one = ix.search_index(spark, index, asked.limit(1), 10, probes=2)
    assert len({f.split("/")[-2] for f in one.sparkSession.read.parquet(f"{index.path}/vectors").inputFiles()}) <= 78 and one.count() == 10


def test_index_of_few_and_no_vectors(spark):
    v = spark.createDataFrame([(str(i), [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(5)], "capsule_id string, vector array<double>")
    index = ix.fit_index(v, workspace(spark, "index"))
    asked = v.withColumnRenamed("capsule_id", "query_id")
    assert answer(ix.search_index(spark, index, asked, 2, probes=3)) == answer(vc.batch_search(v, asked, 2))
    empty = ix.fit_index(v.where("false"), workspace(spark, "index"))
    assert ix.search_index(spark, empty, asked.where("false"), 2).count() == 0


def test_no_queries(tables):
    v, q = tables
    assert vc.batch_search(v, q.filter("false"), K).count() == 0


def test_embedding_is_unit_length(spark):
    df = spark.createDataFrame([("a", "pay pay request"), ("b", "request failed"), ("c", "123")], "id string, t string")
    rows = {r["id"]: np.array(r["vector"]) for r in vc.embed_terms(df, "id", "t").collect()}
    assert set(rows) == {"a", "b"}
    assert all(len(v) == vc.DIMENSION and np.linalg.norm(v) == pytest.approx(1) for v in rows.values())
    assert 0 < rows["a"] @ rows["b"] < 1


def test_contributions(spark):
    df = spark.createDataFrame([("s", "a", 0.9), ("s", "b", 0.6), ("s", "c", 0.5), ("z", "a", 0.0), ("z", "b", 0.0)], "sli_id string, capsule_id string, score double")
    got = [(r["sli_id"], r["capsule_id"], round(r["w"], 6)) for r in df.withColumn("w", ev.contribution(F.col("score"), ["sli_id"])).orderBy("sli_id", "capsule_id").collect()]
    assert got == [("s", "a", 45), ("s", "b", 30), ("s", "c", 25), ("z", "a", 50), ("z", "b", 50)]


def test_trace_choice(spark):
    m = "array<map<string,string>>"
    df = spark.createDataFrame(
        [([{"trace_id": "t1"}, {"trace_id": "t2"}], ["t2"]), ([{"trace_id": ""}, {"message": "m"}, {"trace_id": "t3"}], ["t9"]), ([], ["t1"])],
        f"sample_array {m}, traces array<string>",
    )
    assert [r[0] for r in df.select(ev.pick_trace(F.col("sample_array"), F.col("traces"))).collect()] == ["t2", "t3", None]
    assert [r[0] for r in df.select(ev.first_log_sample(F.col("sample_array"), F.lit("tpl"))).collect()] == ["tpl", "tpl", None]


def test_five_indicators_per_journey(spark):
    df = spark.createDataFrame([("checkout", "/api/pay")], "name string, entry_point string")
    rows = ev.indicator_candidates(df, F.lit("shop")).collect()
    assert [r["sli_name"] for r in rows] == [f"checkout-{s}" for s in ("latency-p50", "latency-p95", "latency-p99", "error-rate", "availability")]
    assert rows[3]["metric_definition"] == (
        '(sum(rate(http_requests_total{job="shop", endpoint="/api/pay", status_code=~"5.."}[5m])) / '
        'sum(rate(http_requests_total{job="shop", endpoint="/api/pay"}[5m]))) * 100'
    )


def test_shown_samples_hold_nothing_to_redact(spark):
    from tidegauge.functions.text import redact
    from tidegauge.plans.vectors import links

    found = links(spark, "/root/testdata/sf0.001")[0].filter("log_sample IS NOT NULL")
    assert found.count() > 0
    again = redact(found.select("log_sample"), "log_sample", mode="strict")
    assert again.filter("redaction_hit").count() == 0


def test_search_with_many_queries_has_one_plan(spark):
    import numpy as np

    from tidegauge.operators.vectors import batch_search

    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(f"c{i}", rng.normal(size=8).tolist()) for i in range(60)], "capsule_id string, vector array<double>")
    ask = [(f"q{i}", rng.normal(size=8).tolist()) for i in range(10_000)]
    queries = spark.createDataFrame(ask, "query_id string, vector array<double>")
    many = batch_search(rows, queries, 2, block_size=512)
    few = batch_search(rows, queries.limit(3), 2)
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(many) == size(few)
    corpus = {r.capsule_id: np.array(r.vector) for r in rows.collect()}
    got = {r.query_id: r.capsule_id for r in many.filter("position = 1").collect()}
    assert len(got) == 10_000
    for q, v in ask[::997]:
        assert got[q] == max(corpus, key=lambda c: float(corpus[c] @ np.array(v)))


def test_evidence_runs_the_pattern_rules_once(spark, monkeypatch):
    """counts and samples of the capsules each ran all pattern rules over all events."""
    from tidegauge.plans import vectors as plans
    from tidegauge.session import materialize, workspace

    folder, read = workspace(spark, "tables"), {}
    spark.createDataFrame([(i, "2024-01-01 00:00:00", i % 5, "error", float(i), None) for i in range(40)],
                          "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"
                          ).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/events.parquet")

    def recorded(df, purpose, *rest):
        read[purpose] = df.inputFiles()
        return materialize(df, purpose, *rest)

    monkeypatch.setattr(plans, "materialize", recorded)
    indicators, capsules = plans.evidence_parts(spark, folder)
    assert indicators.count() == 25 and sum(r["count"] for r in capsules.collect()) == 40
    assert read["capsules"] and not any("events.parquet" in f for f in read["capsules"])
