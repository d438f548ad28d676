"""op1: quality rules over every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.llm.quality import judged
from tidegauge.llm.registry import query
from tidegauge.llm.tables import table


@query("op1_quality")
def quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs, keep_text=False).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("reasons", ",").alias("reasons"),
    )
