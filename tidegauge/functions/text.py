"""Redaction, template masking and fingerprints as column expressions.

Every step is one ``regexp_replace`` in its own projection, so the running text is
computed once per step and the whole chain stays inside one codegen stage.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.constants import MASK_PATTERNS, REDACTION_PATTERNS, STRICT_TOKEN_PATTERN


def redaction_rules(mode: str = "compat"):
    if mode not in ("compat", "strict"):
        raise ValueError(f"unknown redaction mode: {mode}")
    for kind, pattern, replacement in REDACTION_PATTERNS:
        if mode == "strict" and kind == "token":
            pattern = STRICT_TOKEN_PATTERN
        yield kind, pattern, replacement


#: Rules that match digits only together with other things; a text without a digit need not be searched.
DIGIT_RULES = {"ip", "card", "ssn", "phone", "timestamp", "number"}


def _searched(kind: str, text: str) -> Column:
    """Whether a rule can match at all: cheap tests before dear patterns. No replacement adds an at sign or a digit."""
    if kind == "email":
        return F.contains(F.col(text), F.lit("@"))
    return F.col("_digits") if kind in DIGIT_RULES else F.lit(True)


def _replace_all(df: DataFrame, column: str, out: str, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Applies the rules in order. The dear ones are run where their text holds an at
    sign or a digit. No text counts as empty text; a result that cannot be null also
    spares joins a null filter, which the optimizer would evaluate with a second run of
    the whole chain.
    """
    df = df.withColumn(out, F.coalesce(F.col(column), F.lit(""))).withColumn("_digits", F.rlike(out, F.lit("[0-9]")))
    for kind, pattern, replacement in rules:
        df = df.withColumn(out, F.when(_searched(kind, out), F.regexp_replace(out, pattern, replacement)).otherwise(F.col(out)))
    return df.drop("_digits")


def redact(df: DataFrame, column: str, out: str = "redacted", mode: str = "compat") -> DataFrame:
    """Adds the redacted text, ``redaction_hit`` and the always-true ``redaction_checked``."""
    return _replace_all(df, column, out, redaction_rules(mode)).withColumns(
        {
            "redaction_hit": F.coalesce(F.col(out) != F.col(column), F.lit(False)),
            "redaction_checked": F.lit(True),
        }
    )


def count_personal_data(df: DataFrame, column: str, mode: str = "compat") -> DataFrame:
    """Adds ``n_<kind>``: how many replacements each rule makes, in rule order; only texts that a rule changes are counted."""
    out = df.withColumn("_text", F.col(column)).withColumn("_digits", F.rlike("_text", F.lit("[0-9]")))
    for kind, pattern, replacement in redaction_rules(mode):
        changed = F.when(_searched(kind, "_text"), F.regexp_replace("_text", pattern, replacement)).otherwise(F.col("_text"))
        out = out.withColumn("_next", changed)
        count = F.when(F.col("_next") != F.col("_text"), F.regexp_count("_text", F.lit(pattern)).cast("bigint"))
        out = out.withColumn(f"n_{kind}", F.when(F.col("_text").isNotNull(), F.coalesce(count, F.lit(0).cast("bigint"))))
        out = out.withColumn("_text", F.col("_next")).drop("_next")
    return out.drop("_text", "_digits")


def mask(df: DataFrame, column: str, out: str = "template") -> DataFrame:
    """Replaces variable tokens, leaving the message template."""
    return _replace_all(df, column, out, MASK_PATTERNS)


def fingerprint(column: str | Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 template."""
    return F.sha2(F.col(column) if isinstance(column, str) else column, 256)


def template_messages(df: DataFrame, column: str = "message", mode: str = "compat") -> DataFrame:
    """Redact, then mask. ``mode='mask_only'`` leaves redaction out."""
    if mode == "mask_only":
        return mask(df, column)
    return mask(redact(df, column, mode=mode), "redacted")


def fingerprint_messages(df: DataFrame, column: str = "message", mode: str = "compat") -> DataFrame:
    return template_messages(df, column, mode).withColumn("fingerprint_hash", fingerprint("template"))
