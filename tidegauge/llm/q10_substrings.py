"""op10: every document without the bytes it repeats from documents of smaller id."""

from __future__ import annotations

from tidegauge.llm.registry import query
from tidegauge.llm.substrings import deduplicated
from tidegauge.llm.tables import table


@query("op10_suffix_dedup")
def suffix_dedup(spark, folder):
    return deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
