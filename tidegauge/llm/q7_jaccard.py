"""op7: near-duplicate components of all documents."""

from __future__ import annotations

from tidegauge.llm.jaccard import near_duplicates
from tidegauge.llm.registry import query
from tidegauge.llm.tables import table


@query("op7_jaccard_join")
def jaccard_join(spark, folder):
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
