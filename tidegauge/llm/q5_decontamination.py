"""op5: the documents that hold benchmark questions, as they are or with other values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.llm.decontamination import leaks
from tidegauge.llm.registry import query
from tidegauge.llm.tables import table


@query("op5_decontamination")
def decontamination(spark, folder):
    """One row per contaminated document; documents that are clean have none."""
    found = leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", F.lit(True).alias("contaminated"), F.col("items").alias("item_ids"), "covered", "changed")
