"""op9: token ids of every document, from the files they were written to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.registry import query
from tidegauge.llm.tables import table
from tidegauge.llm.token_files import stored_ids
from tidegauge.session import discard, materialize


def digest(docs: DataFrame) -> DataFrame:
    """One narrow row per document; the token files are removed once these rows are stored."""
    stored, folder = stored_ids(docs)
    out = materialize(stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-digests")
    discard(docs.sparkSession, folder)
    return out


@query("op9_token_files")
def token_files(spark, folder):
    return digest(table(spark, folder, "documents"))
