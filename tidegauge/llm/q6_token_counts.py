"""op6: token counts of every document, read off the prefix tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.llm.registry import query
from tidegauge.llm.tables import table
from tidegauge.llm.token_counts import prefix_counts

LIMIT = 1024


@query("op6_token_counts")
def token_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = prefix_counts(docs, budgets=(LIMIT,), keep_table=False)
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), F.col("cuts")[0].alias("cut_bytes")
    )
