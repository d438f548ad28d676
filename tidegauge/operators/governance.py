"""Deployment impact, policies, decisions, domain checks and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.constants import (
    APPROVAL_STATUSES, ARTIFACT_COST_USD, ARTIFACT_TYPES, COMPARISON_OPERATORS, DEFAULT_ARTIFACT_COST_USD, DEFAULT_POLICY,
    DEPLOYMENT_STATUSES, ENFORCEMENT_MODES, ENVIRONMENTS, INVARIANTS, METRIC_TYPES, POLICY_SCOPES, REDACTION_STATUSES,
    SERVICE_STATUSES, SLO_SEVERITIES, SLO_VARIANTS, VALIDATION_STATUSES,
)
from tidegauge.functions.naming import bundle_path

_POLICY = (
    "name string, scope string, scope_id string, invariants map<string,double>, "
    "allowed_actions array<string>, enforcement_mode string, audit_required boolean"
)


def artifact_cost(kind: Column) -> Column:
    price = F.create_map(*[F.lit(x) for pair in ARTIFACT_COST_USD.items() for x in pair])
    return F.coalesce(price[kind], F.lit(DEFAULT_ARTIFACT_COST_USD)).cast("decimal(12,2)")


def resolve_chain(
    artifacts: DataFrame, objectives: DataFrame, indicators: DataFrame, journeys: DataFrame, services: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Artifacts with their objective, indicator, journey and service; and broken links.

    Left joins keep every artifact; the first missing hop names the break. Sizes decide
    the join strategy, nothing is forced to broadcast.
    """
    j = journeys.select("journey_id", "service_id", "traffic_volume_per_day", "endpoints")
    s = services.select("service_id", "organization_id", F.lit(True).alias("_s"))
    chain = (
        artifacts.select("artifact_id", "slo_id", "artifact_type", "action")
        .join(objectives.select("slo_id", "sli_id"), "slo_id", "left")
        .join(indicators.select("sli_id", "journey_id"), "sli_id", "left")
        .join(j, "journey_id", "left")
        .join(s, "service_id", "left")
    )
    missing = (
        F.when(F.col("sli_id").isNull(), "slo").when(F.col("journey_id").isNull(), "sli")
        .when(F.col("service_id").isNull(), "journey").when(F.col("_s").isNull(), "service")
    )
    return (
        chain.filter(missing.isNull()).drop("_s"),
        chain.filter(missing.isNotNull()).select("artifact_id", missing.alias("missing")),
    )


def scope_totals(journeys: DataFrame, services: DataFrame) -> DataFrame:
    """Services and traffic of every organisation, and of all of them (null scope)."""
    traffic = journeys.join(services.select("service_id", "organization_id"), "service_id")
    both = lambda df: df.withColumn("scope", F.explode(F.array(F.col("organization_id"), F.lit(None).cast("string"))))
    counts = both(services).groupBy("scope").agg(F.count(F.lit(1)).alias("total_services"))
    sums = both(traffic).groupBy("scope").agg(F.sum("traffic_volume_per_day").alias("total_traffic"))
    return counts.join(sums, counts["scope"].eqNullSafe(sums["scope"]), "left").select(
        counts["scope"], "total_services", "total_traffic"
    )


def impact(chain: DataFrame, totals: DataFrame, within_organization: bool = False) -> DataFrame:
    """Impact of each artifact: services, endpoints, traffic share, cost."""
    if within_organization:
        scoped = chain.join(totals.filter("scope is not null").withColumnRenamed("scope", "organization_id"), "organization_id")
    else:
        # exactly one row
        scoped = chain.join(F.broadcast(totals.filter("scope is null").drop("scope")), F.lit(True))
    whole = F.coalesce(F.when(F.col("total_traffic") != 0, F.col("total_traffic")), F.lit(1))
    return scoped.select(
        "artifact_id", "artifact_type", "action", "service_id", "organization_id",
        F.lit(1).cast("bigint").alias("affected_services_count"),
        F.round(F.lit(100.0) / F.greatest(F.lit(1), "total_services"), 2).alias("affected_services_percentage"),
        F.greatest(F.lit(1), F.size(F.array_distinct("endpoints"))).cast("bigint").alias("affected_endpoints_count"),
        F.round(F.coalesce("traffic_volume_per_day", F.lit(0)) / whole * 100, 2).alias("affected_traffic_percentage"),
        artifact_cost(F.col("artifact_type")).alias("estimated_cost_impact_usd"),
        F.greatest(F.lit(1), "total_services").alias("total_services_count"),
    )


def batch_impact(impacts: DataFrame, batch: list[str]) -> DataFrame:
    """Combined impact of a batch: services union, endpoints and cost add, traffic is the largest."""
    return impacts.groupBy(*batch).agg(
        F.count_distinct("service_id").alias("affected_services_count"),
        F.sum("affected_endpoints_count").alias("affected_endpoints_count"),
        F.max("affected_traffic_percentage").alias("affected_traffic_percentage"),
        F.sum("estimated_cost_impact_usd").cast("decimal(18,2)").alias("estimated_cost_impact_usd"),
        F.max("total_services_count").alias("total_services_count"),
    ).withColumn(
        "affected_services_percentage",
        F.round(F.col("affected_services_count") / F.col("total_services_count") * 100, 2),
    )


def default_policy(spark: SparkSession) -> DataFrame:
    p = DEFAULT_POLICY
    return spark.createDataFrame(
        [(p["name"], p["scope"], None, p["invariants"], p["allowed_actions"], p["enforcement_mode"], p["audit_required"])],
        _POLICY,
    )


def ensure_default_policy(policies: DataFrame) -> DataFrame:
    """Adds the default policy unless a global policy of that name exists."""
    have = policies.filter((F.col("name") == DEFAULT_POLICY["name"]) & (F.col("scope") == "global"))
    return policies.unionByName(
        default_policy(policies.sparkSession).join(have.select("name").distinct(), "name", "left_anti").select(policies.columns)
    )


def applicable_policies(requests: DataFrame, policies: DataFrame, salts: int = 16) -> DataFrame:
    """Requests with the policies of their scope.

    Global, organisation and service policies are three equi joins on (scope, scope_id)
    in one: every request carries its three scope keys, so no request meets a policy
    that does not apply. A global scope key would gather every request in one task, so
    requests are salted and the global policies copied once per salt.
    """
    scopes = F.array(
        F.struct(F.lit("service").alias("scope"), F.col("service_id").cast("string").alias("scope_id")),
        F.struct(F.lit("organization").alias("scope"), F.col("organization_id").cast("string").alias("scope_id")),
        F.struct(F.lit("global").alias("scope"), F.lit("").alias("scope_id")),
    )
    keyed = requests.withColumn("_salt", F.pmod(F.xxhash64("request_id"), F.lit(salts)).cast("int")).select(
        "*", F.inline(scopes)
    ).filter(F.col("scope_id").isNotNull())
    rules = policies.select(
        F.col("name").alias("policy_name"), "scope",
        F.when(F.col("scope") == "global", "").otherwise(F.col("scope_id")).alias("scope_id"),
        "invariants", "allowed_actions", "enforcement_mode", "audit_required",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )
    return (
        keyed.join(rules, ["scope", "scope_id", "_salt"])
        .filter(F.array_contains("allowed_actions", F.col("action")))
        .drop("_salt", "allowed_actions")
    )


def policy_checks(matched: DataFrame) -> DataFrame:
    """Adds ``violated``: names of the invariants whose limit is exceeded."""
    tests = [
        F.when(F.col(column).cast("double") > F.col("invariants")[name], F.lit(name)) for name, column in INVARIANTS.items()
    ]
    return matched.withColumn("violated", F.array_compact(F.array(*tests)))


def decisions(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """One decision per request: the most specific blocking policy wins.

    A request without any policy is allowed under ``default``; one that no policy
    blocks is allowed under ``all_policies``.
    """
    checked = policy_checks(applicable_policies(requests, policies))
    priority = F.array_position(F.array(*[F.lit(s) for s in POLICY_SCOPES]), F.col("scope"))
    blocks = (F.size("violated") > 0) & (F.col("enforcement_mode") == "block")
    verdict = checked.groupBy("request_id").agg(
        F.min_by(F.when(blocks, F.struct("policy_name", "violated")), F.when(blocks, F.struct(priority.alias("p"), "policy_name")))
        .alias("_b"),
        F.count_if((F.size("violated") > 0) & (F.col("enforcement_mode") == "warn")).alias("warnings"),
    )
    joined = requests.join(verdict, "request_id", "left")
    blocked = F.col("_b").isNotNull()
    return joined.select(
        *requests.columns,
        (~blocked).alias("is_allowed"),
        F.when(blocked, F.col("_b.policy_name")).when(F.col("warnings").isNull(), "default").otherwise("all_policies").alias("policy_name"),
        F.when(blocked, "block").otherwise("audit").alias("enforcement_mode"),
        F.coalesce("_b.violated", F.array().cast("array<string>")).alias("violated_invariants"),
        F.coalesce("warnings", F.lit(0)).alias("warnings"),
    )


def audit_rows(requests: DataFrame, policies: DataFrame, at) -> DataFrame:
    """One row per evaluation of a policy that asks for an audit trail.

    The walk stops at the first blocking policy, which itself is reported as the
    decision and not as an audit event.
    """
    checked = policy_checks(applicable_policies(requests, policies))
    priority = F.array_position(F.array(*[F.lit(s) for s in POLICY_SCOPES]), F.col("scope"))
    blocks = (F.size("violated") > 0) & (F.col("enforcement_mode") == "block")
    place = F.struct(priority.alias("p"), "policy_name")
    stop = checked.filter(blocks).groupBy("request_id").agg(F.min(place).alias("_stop"))
    return (
        checked.join(stop, "request_id", "left")
        .filter(F.col("audit_required") & (F.col("_stop").isNull() | (place < F.col("_stop"))))
        .select(
            "request_id", "policy_name", "scope", "enforcement_mode",
            (F.size("violated") == 0).alias("is_allowed"), "violated",
            F.lit(at).cast("timestamp").alias("evaluated_at"),
        )
    )


def missing_ids(requested: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(found.select(key), key, "left_anti")


def bundles(artifacts: DataFrame, service: Column) -> tuple[DataFrame, DataFrame]:
    """(files of approved artifacts, artifacts that are not approved)."""
    approved = F.col("approval_status") == "approved"
    return (
        artifacts.filter(approved).withColumn("path", bundle_path(F.col("artifact_type"), service)),
        artifacts.filter(~approved),
    )


def constraint_rules(kind: str, columns: list[str]) -> dict[str, Column]:
    """Value constraints of a stored table, for those of its columns that are present."""
    one_of = {
        "service": {"environment": ENVIRONMENTS, "status": SERVICE_STATUSES},
        "indicator": {"metric_type": METRIC_TYPES},
        "objective": {"comparison_operator": COMPARISON_OPERATORS, "severity": SLO_SEVERITIES, "variant": SLO_VARIANTS},
        "artifact": {
            "artifact_type": ARTIFACT_TYPES, "validation_status": VALIDATION_STATUSES, "approval_status": APPROVAL_STATUSES,
            "deployment_status": DEPLOYMENT_STATUSES,
        },
        "policy": {"scope": POLICY_SCOPES, "enforcement_mode": ENFORCEMENT_MODES},
        "evidence": {"redaction_status": REDACTION_STATUSES},
    }
    percent = {
        "journey": ["confidence_score"], "indicator": ["confidence_score"], "objective": ["target_percentage"],
        "evidence": ["confidence_contribution"],
    }
    rules = {c: F.col(c).isin(values) for c, values in one_of.get(kind, {}).items() if c in columns}
    sources = ["capsule_id", "trace_id", "log_sample"]
    if kind == "evidence" and set(sources) <= set(columns):
        rules["at_least_one_source"] = F.coalesce(*[F.col(c).cast("string") for c in sources]).isNotNull()
    return rules | {c: F.col(c).between(0, 100) for c in percent.get(kind, []) if c in columns}


def domain_violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """Ids and rule names of rows that break a rule (null counts as a break)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(id_col), F.explode(broken).alias("rule"))
