"""op2: license scan of every document."""

from __future__ import annotations

from tidegauge.llm.licenses import scan
from tidegauge.llm.registry import query
from tidegauge.llm.tables import table


@query("op2_licenses")
def licenses(spark, folder):
    return scan(table(spark, folder, "documents").select("doc_id", "text"))
