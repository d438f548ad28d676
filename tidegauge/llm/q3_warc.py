"""op3: every page written to Zstandard web archives and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.llm.registry import query
from tidegauge.llm.tables import table
from tidegauge.llm.warc import round_trip
from tidegauge.session import discard, materialize


@query("op3_warc")
def warc(spark, folder):
    read, archives = round_trip(table(spark, folder, "pages"), payloads=False)
    out = materialize(
        read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"), "archive-digests"
    )
    discard(spark, archives)
    return out
