"""Redaction, masking, fingerprints."""

from pyspark.sql import functions as F

from tidegauge.constants import REDACTION_PATTERNS
from tidegauge.functions import text as tx
from tidegauge.plans.ctes import FP, TEL, mask_sql, redact_sql
from tidegauge.plans.registry import query
from tidegauge.sources import adapters
from tidegauge.sources.tables import table


@query("redact_documents", f"""
WITH r AS (SELECT doc_id, text, {redact_sql('text')} AS redacted FROM documents)
SELECT doc_id, sha256(redacted) AS redacted_hash, length(redacted) AS n_chars, redacted <> text AS redaction_hit,
  TRUE AS redaction_checked FROM r""")
def redact_documents(spark, d):
    return tx.redact(table(spark, d, "documents").select("doc_id", "text"), "text").select(
        "doc_id", F.sha2("redacted", 256).alias("redacted_hash"), F.length("redacted").alias("n_chars"),
        "redaction_hit", "redaction_checked",
    )


@query("redact_conversations", f"""
SELECT conv_id, turn, role, sha256({redact_sql('text')}) AS redacted_hash FROM conversations""")
def redact_conversations(spark, d):
    return tx.redact(table(spark, d, "conversations"), "text").select(
        "conv_id", "turn", "role", F.sha2("redacted", 256).alias("redacted_hash")
    )


@query("redact_messages_strict", f"""
WITH {TEL} SELECT event_id, {redact_sql('message', strict=True)} AS redacted FROM tel""")
def redact_messages_strict(spark, d):
    return tx.redact(adapters.telemetry(spark, d).select("event_id", "message"), "message", mode="strict").select(
        "event_id", "redacted"
    )


def _count_sql() -> str:
    text, cols = "text", []
    for kind, pattern, replacement in REDACTION_PATTERNS:
        cols.append(f"sum(len(regexp_extract_all({text}, '{pattern}'))) AS n_{kind}")
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return f"SELECT source, count(*) AS documents, {', '.join(cols)} FROM documents GROUP BY source"


@query("personal_data_by_source", _count_sql())
def personal_data_by_source(spark, d):
    counted = tx.count_personal_data(table(spark, d, "documents").select("source", "text"), "text")
    return counted.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k, _, _ in REDACTION_PATTERNS]
    )


@query("mask_documents", f"""
SELECT doc_id, sha256({mask_sql('text')}) AS fingerprint_hash FROM documents""")
def mask_documents(spark, d):
    return tx.mask(table(spark, d, "documents").select("doc_id", "text"), "text").select(
        "doc_id", tx.fingerprint("template").alias("fingerprint_hash")
    )


@query("message_fingerprints", f"""
WITH {FP} SELECT fingerprint_hash, template, count(*) AS events FROM fp GROUP BY ALL""")
def message_fingerprints(spark, d):
    return tx.fingerprint_messages(adapters.telemetry(spark, d).select("message")).groupBy(
        "fingerprint_hash", "template"
    ).agg(F.count(F.lit(1)).alias("events"))


@query("mask_only_fingerprints", f"""
WITH {TEL}, m AS (SELECT {mask_sql('message')} AS template FROM tel)
SELECT sha256(template) AS fingerprint_hash, template, count(*) AS events FROM m GROUP BY ALL""")
def mask_only_fingerprints(spark, d):
    return tx.fingerprint_messages(adapters.telemetry(spark, d).select("message"), mode="mask_only").groupBy(
        "fingerprint_hash", "template"
    ).agg(F.count(F.lit(1)).alias("events"))
