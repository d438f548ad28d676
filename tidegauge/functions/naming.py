"""Labels, names, durations and query texts as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def step_label(service: Column, span: Column) -> Column:
    return F.concat_ws(":", service, span)


def journey_name(entry: Column, exit_: Column) -> Column:
    text = F.concat(
        F.substring_index(entry, ":", -1), F.lit("-to-"), F.substring_index(exit_, ":", -1)
    )
    return F.lower(F.translate(text, "/_", "--"))


def service_of_entry(entry: Column) -> Column:
    """First path segment once outer slashes are gone."""
    return F.split(F.btrim(entry, F.lit("/")), "/").getItem(0)


def metric_kind(sli_name: Column) -> Column:
    name = F.lower(sli_name)
    return (
        F.when(name.contains("error"), "errors")
        .when(name.contains("availability"), "availability")
        .when(name.contains("latency"), "latency")
        .otherwise("performance")
    )


def evidence_query(sli_name: Column, journey: Column, entry: Column) -> Column:
    return F.concat(
        metric_kind(sli_name), F.lit(" issues in "), journey,
        F.lit(" endpoint "), entry, F.lit(" user journey flow"),
    )


def recording_rule_name(service: Column, sli: Column) -> Column:
    return F.concat(
        F.translate(service, "-.", "__"), F.lit(":"), F.translate(sli, "-.", "__"), F.lit(":recording")
    )


def _camel(text: Column) -> Column:
    parts = F.split(F.translate(text, "_", "-"), "-")
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))),
        "",
    )


def alert_name(service: Column, sli: Column, severity: Column) -> Column:
    cap = F.concat(F.upper(F.left(severity, F.lit(1))), F.lower(F.substr(severity, F.lit(2))))
    return F.concat(_camel(service), _camel(sli), cap)


def bundle_path(artifact_type: Column, service: Column) -> Column:
    """Where an approved artifact lands in a deployment bundle."""
    safe = F.translate(F.lower(service), " _", "--")
    return (
        F.when(artifact_type == "prometheus_recording",
               F.concat(F.lit("prometheus/recording_rules/"), safe, F.lit("_recording_rules.yml")))
        .when(artifact_type == "prometheus_alert",
              F.concat(F.lit("prometheus/alert_rules/"), safe, F.lit("_alert_rules.yml")))
        .when(artifact_type == "grafana_dashboard",
              F.concat(F.lit("grafana/dashboards/"), safe, F.lit("_dashboard.json")))
        .when(artifact_type == "runbook",
              F.concat(F.lit("runbooks/"), safe, F.lit("_runbook.yml")))
    )


def duration_seconds(text: Column) -> Column:
    """Seconds of ``<digits><d|h|m|s>``; null for any other text."""
    number = F.regexp_extract(text, r"^(\d+)([dhms])$", 1)
    unit = F.regexp_extract(text, r"^(\d+)([dhms])$", 2)
    scale = F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).when(unit == "s", 1)
    return F.when(unit != "", number.try_cast("bigint") * scale)


def duration_text(seconds: Column) -> Column:
    """Largest unit that divides the duration exactly."""
    def show(unit: int, suffix: str) -> Column:
        return F.concat((seconds / unit).cast("bigint").cast("string"), F.lit(suffix))

    return (
        F.when(seconds % 86400 == 0, show(86400, "d"))
        .when(seconds % 3600 == 0, show(3600, "h"))
        .when(seconds % 60 == 0, show(60, "m"))
        .otherwise(show(1, "s"))
    )


def redaction_status(redacted: Column) -> Column:
    return F.when(redacted, "redacted").otherwise("pending")


def visible_sample(sample: Column, status: Column) -> Column:
    """A log sample is shown only once it is redacted."""
    return F.when(status == "redacted", sample)


def latency_expression(service: Column, endpoint: Column, quantile: float) -> Column:
    return F.concat(
        F.lit(f'histogram_quantile({quantile}, sum by (le) (rate(http_request_duration_seconds_bucket{{job="'),
        service, F.lit('", endpoint="'), endpoint, F.lit('"}[5m]))) * 1000'),
    )


def status_ratio_expression(service: Column, endpoint: Column, matcher: str) -> Column:
    labels = F.concat(F.lit('job="'), service, F.lit('", endpoint="'), endpoint, F.lit('"'))
    return F.concat(
        F.lit("(sum(rate(http_requests_total{"), labels, F.lit(f', status_code{matcher}"5.."'),
        F.lit("}[5m])) / sum(rate(http_requests_total{"), labels, F.lit("}[5m]))) * 100"),
    )
