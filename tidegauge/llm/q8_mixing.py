"""op8: all documents mixed to the target weights of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.mixing import mixed
from tidegauge.llm.registry import query
from tidegauge.llm.tables import table
from tidegauge.llm.words import n_words
from tidegauge.session import materialize

SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS skey,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 8) AS BIGINT) AS h
  FROM documents),
b AS (SELECT *, greatest(length(bin(size)) - 4, 0) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS bucket FROM d),
p AS (SELECT *, h % CAST(ceil(count(*) OVER (PARTITION BY skey, bucket) / 4096.0) AS BIGINT) AS part FROM b),
i AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY bucket, part, size, doc_id) AS place FROM p),
s AS (SELECT skey, sum(size) AS source_size, 3 * sum(size) AS most,
             CAST(1 + (row_number() OVER (ORDER BY skey) - 1) % 3 AS BIGINT) AS weight FROM d GROUP BY skey),
l AS (SELECT *, CAST(sum(source_size) OVER () - sum(most) OVER u + most AS DOUBLE) / CAST(sum(weight) OVER () - sum(weight) OVER u + weight AS DOUBLE) AS level,
             row_number() OVER (ORDER BY CAST(most AS DOUBLE) / weight, skey) AS pos
      FROM s WINDOW u AS (ORDER BY CAST(most AS DOUBLE) / weight, skey ROWS UNBOUNDED PRECEDING)),
f AS (SELECT level AS free FROM l WHERE level * weight <= most ORDER BY pos LIMIT 1),
t AS (SELECT skey, CAST(source_size AS BIGINT) AS source_size, least(CAST(most AS DOUBLE), weight * free) AS target,
             CAST('0x' || substr(md5('mix' || skey), 1, 8) AS BIGINT) % 1048576 AS shift FROM l, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 1048576) AS BIGINT) ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       size * (((place * rate + shift) >> 20) - (((place - 1) * rate + shift) >> 20)) AS taken
FROM i JOIN r USING (skey)
"""


def copies(docs: DataFrame, **options) -> DataFrame:
    """The operator on narrow rows: sizes are counted once and stored, the text goes no further."""
    digest = F.md5(F.coalesce("text", F.lit(""))).alias("digest")
    narrow = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("n_words"), digest), "mix-sizes")
    return mixed(narrow, text="n_words", size=F.col("n_words"), digest=F.col("digest"), **options)


@query("op8_mixing", SQL)
def mixing(spark, folder):
    mix = copies(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return mix.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
