"""Deployment impact, policies, decisions, bundles."""

from pyspark.sql import functions as F

from tidegauge.functions.scoring import journey_confidence
from tidegauge.operators import governance as gv
from tidegauge.plans.ctes import CATALOG, JOURNEYS
from tidegauge.plans.registry import joined, query, r6
from tidegauge.plans.traces import found
from tidegauge.plans.vectors import _LINKS, links
from tidegauge.sources import adapters
from tidegauge.sources.tables import table


def parts(spark, d):
    return (
        adapters.artifacts(spark, d), adapters.objectives(spark, d), adapters.indicators(spark, d),
        adapters.journeys(spark, d), adapters.services(spark, d),
    )


def impacts(spark, d, within=False):
    a, o, i, j, s = parts(spark, d)
    chain, _ = gv.resolve_chain(a, o, i, j, s)
    return gv.impact(chain, gv.scope_totals(j, s), within)


def plain_cost(df):
    return df.withColumn("estimated_cost_impact_usd", F.col("estimated_cost_impact_usd").cast("double"))


@query("artifact_chain", f"""
WITH {CATALOG} SELECT artifact_id, artifact_type, sli_id, journey_id, service_id, organization_id FROM chain WHERE organization_id IS NOT NULL""")
def artifact_chain(spark, d):
    chain, _ = gv.resolve_chain(*parts(spark, d))
    return chain.select("artifact_id", "artifact_type", "sli_id", "journey_id", "service_id", "organization_id")


@query("broken_links", f"""
WITH {CATALOG} SELECT artifact_id, CASE WHEN sli_id IS NULL THEN 'slo' WHEN journey_id IS NULL THEN 'journey' ELSE 'service' END AS missing FROM chain WHERE organization_id IS NULL""")
def broken_links(spark, d):
    return gv.resolve_chain(*parts(spark, d))[1].replace({"sli": "journey"}, subset=["missing"])


@query("scope_totals", f"""
WITH {CATALOG}, t AS (SELECT organization_id AS scope, count(*) AS total_services FROM services GROUP BY ALL UNION ALL SELECT 'all', count(*) FROM services),
u AS (SELECT organization_id AS scope, sum(traffic_volume_per_day) AS total_traffic FROM catj JOIN services USING (service_id) GROUP BY ALL
  UNION ALL SELECT 'all', sum(traffic_volume_per_day) FROM catj JOIN services USING (service_id))
SELECT scope, total_services, CAST(coalesce(total_traffic, 0) AS BIGINT) AS total_traffic FROM t LEFT JOIN u USING (scope)""")
def scope_totals(spark, d):
    t = gv.scope_totals(adapters.journeys(spark, d), adapters.services(spark, d))
    return t.select(F.coalesce("scope", F.lit("all")).alias("scope"), "total_services", F.coalesce("total_traffic", F.lit(0)).alias("total_traffic"))


@query("deployment_impact", f"""
WITH {CATALOG} SELECT artifact_id, artifact_type, affected_services_count, affected_services_percentage, affected_endpoints_count,
  round(affected_traffic_percentage, 6) AS affected_traffic_percentage, estimated_cost_impact_usd FROM impact""")
def deployment_impact(spark, d):
    return plain_cost(impacts(spark, d)).select(
        "artifact_id", "artifact_type", "affected_services_count", "affected_services_percentage", "affected_endpoints_count",
        r6("affected_traffic_percentage").alias("affected_traffic_percentage"), "estimated_cost_impact_usd",
    )


@query("impact_in_organization", f"""
WITH {CATALOG}, n AS (SELECT organization_id, count(*) AS n FROM services GROUP BY ALL),
t AS (SELECT organization_id, sum(traffic_volume_per_day) AS t FROM catj JOIN services USING (service_id) GROUP BY ALL)
SELECT artifact_id, round(100.0 / n, 2) AS affected_services_percentage, round(traffic_volume_per_day / t * 100, 2) AS affected_traffic_percentage
FROM chain JOIN n USING (organization_id) JOIN t USING (organization_id)""")
def impact_in_organization(spark, d):
    return impacts(spark, d, True).select("artifact_id", "affected_services_percentage", "affected_traffic_percentage")


_BATCH = CATALOG + """,
batch AS (SELECT organization_id, artifact_type, count(DISTINCT service_id) AS affected_services_count, CAST(sum(affected_endpoints_count) AS BIGINT) AS affected_endpoints_count,
  max(affected_traffic_percentage) AS affected_traffic_percentage, sum(estimated_cost_impact_usd) AS estimated_cost_impact_usd,
  round(count(DISTINCT service_id) / (SELECT count(*) FROM services) * 100, 2) AS affected_services_percentage FROM impact GROUP BY ALL)"""


@query("batch_impact", f"WITH {_BATCH} SELECT * FROM batch")
def batch_impact(spark, d):
    return plain_cost(gv.batch_impact(impacts(spark, d), ["organization_id", "artifact_type"])).drop("total_services_count")


def policies(spark, d):
    """Blocking limits per organisation, warnings per well-funded service, one global audit rule."""
    region = table(spark, d, "region")
    org = region.select(
        F.concat(F.lit("cap-"), F.lower("r_name")).alias("name"), F.lit("organization").alias("scope"),
        F.concat(F.lit("org-"), F.col("r_regionkey").cast("string")).alias("scope_id"),
        F.create_map(F.lit("max_endpoints_affected"), (F.col("r_regionkey") + 1).cast("double"), F.lit("max_cost_impact_usd"), F.lit(8.0)).alias("invariants"),
        F.array(F.lit("deploy")).alias("allowed_actions"), F.lit("block").alias("enforcement_mode"), F.lit(True).alias("audit_required"),
    )
    svc = table(spark, d, "supplier").filter("s_acctbal > 5000").select(
        F.concat(F.lit("svc-cap-"), F.col("s_suppkey").cast("string")).alias("name"), F.lit("service").alias("scope"),
        F.col("s_suppkey").cast("string").alias("scope_id"), F.create_map(F.lit("max_cost_impact_usd"), F.lit(1.5)).alias("invariants"),
        F.array(F.lit("deploy"), F.lit("approve")).alias("allowed_actions"), F.lit("warn").alias("enforcement_mode"), F.lit(True).alias("audit_required"),
    )
    return gv.ensure_default_policy(org.unionByName(svc))


_POLICY = CATALOG + """,
reg AS (SELECT 'org-' || r_regionkey AS organization_id, 'cap-' || lower(r_name) AS org_policy, r_regionkey + 1 AS max_endpoints FROM region),
svcp AS (SELECT s_suppkey AS service_id FROM supplier WHERE s_acctbal > 5000),
dec AS (
  SELECT i.artifact_id, i.organization_id, i.artifact_type, reg.org_policy,
    svcp.service_id IS NOT NULL AND estimated_cost_impact_usd > 1.5 AS warned, svcp.service_id IS NOT NULL AS has_svc, i.service_id,
    affected_endpoints_count > max_endpoints AS v_end, estimated_cost_impact_usd > 8 AS v_cost,
    affected_services_percentage > 10 AS g_pct
  FROM impact i JOIN reg USING (organization_id) LEFT JOIN svcp ON svcp.service_id = i.service_id)"""


def requests(spark, d):
    return impacts(spark, d).withColumn("request_id", F.col("artifact_id"))


@query("policy_decisions", f"""
WITH {_POLICY} SELECT artifact_id, NOT (v_end OR v_cost OR g_pct) AS is_allowed,
  CASE WHEN v_end OR v_cost THEN org_policy WHEN g_pct THEN 'default-blast-radius' ELSE 'all_policies' END AS policy_name,
  CASE WHEN v_end OR v_cost OR g_pct THEN 'block' ELSE 'audit' END AS enforcement_mode,
  CASE WHEN v_cost AND v_end THEN 'max_cost_impact_usd,max_endpoints_affected' WHEN v_cost THEN 'max_cost_impact_usd' WHEN v_end THEN 'max_endpoints_affected'
    WHEN g_pct THEN 'max_services_percentage' ELSE '' END AS violated_invariants, CASE WHEN warned THEN 1 ELSE 0 END AS warnings FROM dec""")
def policy_decisions(spark, d):
    return gv.decisions(requests(spark, d), policies(spark, d)).select(
        "artifact_id", "is_allowed", "policy_name", "enforcement_mode", joined("violated_invariants"), "warnings"
    )


@query("policy_audit", f"""
WITH {_POLICY}, a AS (
  SELECT artifact_id AS request_id, 'svc-cap-' || service_id AS policy_name, 'service' AS scope, 'warn' AS enforcement_mode, NOT warned AS is_allowed,
    CASE WHEN warned THEN 'max_cost_impact_usd' ELSE '' END AS violated FROM dec WHERE has_svc
  UNION ALL SELECT artifact_id, org_policy, 'organization', 'block', TRUE, '' FROM dec WHERE NOT (v_end OR v_cost)
  UNION ALL SELECT artifact_id, 'default-blast-radius', 'global', 'block', TRUE, '' FROM dec WHERE NOT (v_end OR v_cost OR g_pct))
SELECT * FROM a""")
def policy_audit(spark, d):
    return gv.audit_rows(requests(spark, d), policies(spark, d), "2024-02-01").select(
        "request_id", "policy_name", "scope", "enforcement_mode", "is_allowed", joined("violated")
    )


@query("policy_matches", f"""
WITH {_POLICY} SELECT scope, count(*) AS matches FROM (
  SELECT 'organization' AS scope FROM dec UNION ALL SELECT 'global' FROM dec UNION ALL SELECT 'service' FROM dec WHERE has_svc) GROUP BY scope""")
def policy_matches(spark, d):
    return gv.applicable_policies(requests(spark, d), policies(spark, d)).groupBy("scope").agg(F.count(F.lit(1)).alias("matches"))


@query("batch_decisions", f"""
WITH {_BATCH} SELECT organization_id || '/' || artifact_type AS request_id,
  NOT (affected_services_count > 5 OR affected_services_percentage > 10 OR estimated_cost_impact_usd > 100) AS is_allowed,
  concat_ws(',', CASE WHEN affected_services_count > 5 THEN 'max_services_affected' END, CASE WHEN affected_services_percentage > 10 THEN 'max_services_percentage' END,
    CASE WHEN estimated_cost_impact_usd > 100 THEN 'max_cost_impact_usd' END) AS violated_invariants FROM batch""")
def batch_decisions(spark, d):
    batch = gv.batch_impact(impacts(spark, d), ["organization_id", "artifact_type"]).select(
        F.concat_ws("/", "organization_id", "artifact_type").alias("request_id"), "*",
        F.lit(None).cast("string").alias("service_id"), F.lit("deploy").alias("action"),
    )
    return gv.decisions(batch, gv.default_policy(spark)).select("request_id", "is_allowed", joined("violated_invariants"))


@query("artifact_bundles", f"""
WITH {CATALOG} SELECT a.artifact_id, CASE artifact_type WHEN 'prometheus_recording' THEN 'prometheus/recording_rules/' || n || '_recording_rules.yml'
  WHEN 'prometheus_alert' THEN 'prometheus/alert_rules/' || n || '_alert_rules.yml' WHEN 'grafana_dashboard' THEN 'grafana/dashboards/' || n || '_dashboard.json'
  ELSE 'runbooks/' || n || '_runbook.yml' END AS path
FROM (SELECT *, replace(lower(p_name), ' ', '-') AS n FROM arts JOIN part USING (p_partkey)) a WHERE approval_status = 'approved'""")
def artifact_bundles(spark, d):
    named = adapters.artifacts(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("slo_id"), "p_name"), "slo_id")
    return gv.bundles(named, F.col("p_name"))[0].select("artifact_id", "path")


@query("unapproved_artifacts", f"WITH {CATALOG} SELECT artifact_id, artifact_type FROM arts WHERE approval_status <> 'approved'")
def unapproved_artifacts(spark, d):
    return gv.bundles(adapters.artifacts(spark, d), F.lit("all"))[1].select("artifact_id", "artifact_type")


@query("artifact_counts", f"WITH {CATALOG} SELECT artifact_type, approval_status, count(*) AS artifacts FROM arts GROUP BY ALL")
def artifact_counts(spark, d):
    return adapters.artifacts(spark, d).groupBy("artifact_type", "approval_status").agg(F.count(F.lit(1)).alias("artifacts"))


@query("missing_parts", """
SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 50)""")
def missing_parts(spark, d):
    have = table(spark, d, "part").filter("p_size < 50").select(F.col("p_partkey").alias("l_partkey"))
    return gv.missing_ids(table(spark, d, "lineitem"), have, "l_partkey")


@query("affected_services", f"""
WITH {CATALOG} SELECT DISTINCT service_id FROM impact""")
def affected_services(spark, d):
    i = impacts(spark, d)
    alerts = i.filter(F.col("artifact_type") == "prometheus_alert").select("service_id")
    rest = i.filter(F.col("artifact_type") != "prometheus_alert").select("service_id")
    return alerts.union(rest).distinct()


@query("default_policy", """
SELECT count(*) AS policies, count(*) FILTER (d) AS default_policies FROM (
  SELECT FALSE AS d FROM region UNION ALL SELECT FALSE FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT TRUE)""")
def default_policy(spark, d):
    return policies(spark, d).agg(
        F.count(F.lit(1)).alias("policies"), F.count_if(F.col("name") == "default-blast-radius").alias("default_policies")
    )


@query("constraint_violations", """
WITH r AS (
  SELECT 'service' AS kind, (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey) AS rows, 0 AS broken UNION ALL
  SELECT 'indicator', (SELECT count(*) FROM part), 0 UNION ALL
  SELECT 'objective', (SELECT count(*) FROM part WHERE p_size < 50), (SELECT count(*) FROM part WHERE p_size < 50 AND p_size * 2.5 > 100) UNION ALL
  SELECT 'artifact', (SELECT 4 * count(*) FROM part), 0 UNION ALL
  SELECT 'policy', (SELECT count(*) FROM region) + (SELECT count(*) FROM supplier WHERE s_acctbal > 5000) + 1, 0)
SELECT kind, CAST(rows AS BIGINT) AS rows, CAST(broken AS BIGINT) AS broken FROM r""")
def constraint_violations(spark, d):
    """Stored tables against their value constraints; objectives take 2.5 times the part size as target."""
    targets = adapters.objectives(spark, d).withColumn("target_percentage", F.col("threshold_value") * 2.5)
    tables = {
        "service": (adapters.services(spark, d), "service_id"), "indicator": (adapters.indicators(spark, d), "sli_id"),
        "objective": (targets, "slo_id"), "artifact": (adapters.artifacts(spark, d), "artifact_id"), "policy": (policies(spark, d), "name"),
    }
    out = None
    for kind, (df, key) in tables.items():
        broken = gv.domain_violations(df, key, gv.constraint_rules(kind, df.columns)).agg(F.count(F.lit(1)).alias("broken"))
        row = df.agg(F.count(F.lit(1)).alias("rows")).join(broken, F.lit(True)).select(F.lit(kind).alias("kind"), "rows", "broken")
        out = row if out is None else out.unionByName(row)
    return out


@query("evidence_violations", f"""
WITH {_LINKS}, e AS (SELECT position > 1 AS capsule, trace_id IS NOT NULL AS trace, position > 2 AS sample, contribution * 1.5 AS c FROM lk)
SELECT rule, count(*) AS rows FROM (
  SELECT 'at_least_one_source' AS rule FROM e WHERE NOT capsule AND NOT trace AND NOT sample UNION ALL SELECT 'confidence_contribution' FROM e WHERE c > 100) GROUP BY rule""")
def evidence_violations(spark, d):
    """Evidence rows that lost their capsule (first hits) or sample (first two), with weights half as large again."""
    first = lambda c, n: F.when(F.col("position") > n, F.col(c)).alias(c)
    rows = links(spark, d)[0].select("sli_id", first("capsule_id", 1), "trace_id", first("log_sample", 2), "redaction_status",
                                     (F.col("confidence_contribution") * 1.5).alias("confidence_contribution"))
    return gv.domain_violations(rows, "sli_id", gv.constraint_rules("evidence", rows.columns)).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@query("journey_violations", f"""
WITH {JOURNEYS} SELECT entry_point, 'confidence_score' AS rule FROM ranked0 WHERE confidence_score * 2 > 100""")
def journey_violations(spark, d):
    """Confidence scores of journeys, doubled, against their range."""
    rows = found(spark, d).select("entry_point", (journey_confidence(
        F.col("traffic_volume"), F.size("sample_trace_ids"), F.size("step_sequence")) * 2).alias("confidence_score"))
    return gv.domain_violations(rows, "entry_point", gv.constraint_rules("journey", rows.columns))


@query("catalog_domain_violations", f"""
WITH {CATALOG} SELECT rule, count(*) AS rows FROM (
  SELECT 'status' AS rule FROM services WHERE status <> 'active' UNION ALL
  SELECT 'threshold' FROM part WHERE p_size < 50 AND p_size > 40) GROUP BY rule""")
def catalog_domain_violations(spark, d):
    bad = gv.domain_violations(adapters.services(spark, d), "service_id", {"status": F.col("status") == "active"}).select("rule").unionByName(
        gv.domain_violations(adapters.objectives(spark, d), "slo_id", {
            "operator": F.col("comparison_operator").isin("lt", "lte", "gt", "gte", "eq"),
            "target": F.col("target_percentage").between(0, 100), "threshold": F.col("threshold_value") <= 40}).select("rule")
    )
    return bad.groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))
