"""op12: every document without the words it repeats from documents of smaller id."""

from __future__ import annotations

from tidegauge.llm.registry import query
from tidegauge.llm.tables import table
from tidegauge.llm.window_trees import deduplicated

SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS first FROM v GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM v JOIN f USING (win) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM d),
r AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS body FROM x ANTI JOIN g USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query("op12_substring_dedup", SQL)
def substring_dedup(spark, folder):
    return deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
