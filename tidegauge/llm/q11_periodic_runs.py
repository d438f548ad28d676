"""op11: periodic runs of all documents, a tenth of which first get a periodic tail by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.periodic_runs import periodic_runs
from tidegauge.llm.registry import query
from tidegauge.llm.tables import table
from tidegauge.llm.words import WORD

SQL = r"""
WITH c AS (
  SELECT doc_id, text, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
           lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h
  FROM documents),
d AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM c),
s AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a, g FROM d),
t AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM s),
x AS (SELECT doc_id, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word
      FROM (SELECT *, unnest(range(0, n)) AS i FROM t)),
e AS (SELECT u.doc_id, v.i - u.i AS q, u.i AS i FROM x u JOIN x v ON u.doc_id = v.doc_id AND u.word = v.word AND u.i < v.i),
b AS (SELECT doc_id, q, min(i) AS start, count(*) AS same FROM (
        SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, same + q AS length, min(q) AS period FROM b WHERE same >= q AND same + q >= 12 GROUP BY doc_id, start, same + q),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS place FROM r),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS body FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines.body, '')) AS runs_sha256, sha256(coalesce(kept.body, '')) AS collapsed_sha256
FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT * FROM best WHERE place = 1) best USING (doc_id)
"""


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id) ends in 0 the words from a on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w"))
    some = some.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    whole = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), rest)), " ")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", SQL)
def found_runs(spark, folder):
    found = periodic_runs(planted(table(spark, folder, "documents").select("doc_id", "text")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    body = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), first.alias("first"), F.sha2(body, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("first.less")
    return rows.select("doc_id", "n_runs", F.col("first.start").alias("start"), length.alias("length"), F.col("first.period").alias("period"),
                       F.floor(1000 * length / F.col("first.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
