"""op13: product codes of all vectors, their errors and a digest of the codebooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.llm.registry import query
from tidegauge.llm.tables import table
from tidegauge.llm.vector_codes import books_digest, compressed, label_errors
from tidegauge.session import materialize


def sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    steps = [f"""
kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, len(embedding) // {parts} AS w, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS (SELECT r, (i - 1) // w AS p, (i - 1) % w AS i, CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, w, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM kept)),
book0 AS (SELECT p, r - 1 AS e, i, x AS y FROM comp WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS (SELECT r, p, min(d * 256 + e) % 256 AS e, min(d) AS d FROM (
  SELECT r, c.p, e, sum((x - y) * (x - y)) AS d FROM comp c JOIN book{k} b ON c.p = b.p AND c.i = b.i GROUP BY r, c.p, e) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""
book{k + 1} AS (SELECT b.p, b.e, b.i, coalesce(m.y, b.y) AS y FROM book{k} b LEFT JOIN (
  SELECT c.p, n.e, c.i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS y
  FROM comp c JOIN near{k} n ON c.r = n.r AND c.p = n.p GROUP BY c.p, n.e, c.i) m ON b.p = m.p AND b.e = m.e AND b.i = m.i)""")
    return "WITH" + ",".join(steps) + f""",
coded AS (SELECT r, string_agg(printf('%02x', CAST(e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest"""


@query("op13_vector_codes", sql())
def vector_codes(spark, folder):
    codes = compressed(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
    rows = label_errors(materialize(codes.rows, "vector-codes"))
    return rows.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(codes.books)).alias("codebooks_sha256"))
