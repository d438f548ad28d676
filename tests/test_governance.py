from pyspark.sql import functions as F

from tidegauge.operators import governance as gv

COLS = ("request_id string, service_id string, organization_id string, action string, affected_services_count bigint, "
        "affected_services_percentage double, affected_endpoints_count bigint, affected_traffic_percentage double, estimated_cost_impact_usd decimal(12,2)")


def request(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(r, "s1", "o1", "deploy", n, p, 1, 1.0, Decimal(c)) for r, n, p, c in rows], COLS)


def decide(df, policies):
    return {r["request_id"]: r for r in gv.decisions(df, policies).collect()}


def test_default_policy_facts(spark):
    got = decide(request(spark, [("third", 1, 33.33, "10"), ("tiny", 3, 0.3, "10"), ("dear", 1, 1.0, "500"), ("edge", 5, 10.0, "100")]), gv.default_policy(spark))
    assert got["third"]["violated_invariants"] == ["max_services_percentage"]
    assert got["tiny"]["is_allowed"] and got["tiny"]["policy_name"] == "all_policies"
    assert got["dear"]["violated_invariants"] == ["max_cost_impact_usd"]
    assert got["edge"]["is_allowed"]  # a limit is broken only when exceeded


def test_specific_scope_wins_and_modes(spark):
    rows = [
        ("svc", "service", "s1", {"max_cost_impact_usd": 1.0}, ["deploy"], "block", True),
        ("org", "organization", "o1", {"max_cost_impact_usd": 1.0}, ["deploy"], "block", True),
        ("other", "service", "s9", {"max_cost_impact_usd": 0.0}, ["deploy"], "block", True),
        ("warner", "global", None, {"max_cost_impact_usd": 1.0}, ["deploy"], "warn", True),
        ("approver", "global", None, {"max_cost_impact_usd": 0.0}, ["approve"], "block", True),
    ]
    policies = spark.createDataFrame(rows, gv._POLICY)
    df = request(spark, [("r", 1, 1.0, "10"), ("cheap", 1, 1.0, "1")])
    got = decide(df, policies)
    assert (got["r"]["policy_name"], got["r"]["enforcement_mode"]) == ("svc", "block")
    assert got["cheap"]["is_allowed"] and got["cheap"]["warnings"] == 0
    only_warn = decide(df, policies.filter("enforcement_mode = 'warn'"))
    assert only_warn["r"]["is_allowed"] and only_warn["r"]["warnings"] == 1
    nothing = decide(df, policies.filter("name = 'other'"))
    assert nothing["r"]["policy_name"] == "default"
    # the walk stops before the blocking policy's audit
    assert gv.audit_rows(df.filter("request_id = 'r'"), policies, "2024-01-01").count() == 0
    audited = sorted(r["policy_name"] for r in gv.audit_rows(df.filter("request_id = 'cheap'"), policies, "2024-01-01").collect())
    assert audited == ["org", "svc", "warner"]


def test_default_policy_is_added_once(spark):
    have = gv.default_policy(spark)
    assert gv.ensure_default_policy(have).count() == 1
    assert gv.ensure_default_policy(have.withColumn("name", F.lit("x"))).count() == 2


def test_batch_counts_services_once(spark):
    df = request(spark, [("a", 1, 1.0, "10"), ("b", 1, 1.0, "2.50")]).withColumns({"total_services_count": F.lit(4).cast("bigint"), "batch": F.lit("x")})
    row = gv.batch_impact(df, ["batch"]).first()
    assert row["affected_services_count"] == 1 and str(row["estimated_cost_impact_usd"]) == "12.50"
    assert row["affected_services_percentage"] == 25 and row["affected_endpoints_count"] == 2


def test_costs_and_paths(spark):
    df = spark.createDataFrame([("runbook",), ("prometheus_alert",), ("odd",)], "k string")
    assert [str(r[0]) for r in df.select(gv.artifact_cost(F.col("k"))).collect()] == ["1.00", "10.00", "1.00"]
    arts = spark.createDataFrame([("1", "runbook", "approved"), ("2", "runbook", "pending")], "artifact_id string, artifact_type string, approval_status string")
    files, refused = gv.bundles(arts, F.lit("Pay Svc_1"))
    assert [r["path"] for r in files.collect()] == ["runbooks/pay-svc-1_runbook.yml"]
    assert [r["artifact_id"] for r in refused.collect()] == ["2"]
