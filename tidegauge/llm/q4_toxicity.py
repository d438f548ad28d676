"""op4: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.llm.registry import query
from tidegauge.llm.tables import table
from tidegauge.llm.toxicity import held_out, scored, train

TOXIC = 0.7


@query("op4_toxicity")
def toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels"))
    found = scored(docs, model)
    return found.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"), "exact", "near", "quoted",
    )
