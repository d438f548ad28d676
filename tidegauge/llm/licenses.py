"""License scans by a positional index of rare licence words.

One pass over the texts keeps, of every file, the positions of licence words: the index.
Document frequencies come from the index. Each template is looked up by the highest-IDF
word of its key phrase; a hit at position p of a word that stands at j in the template
proposes the place p - j. All index entries of a file that agree on template and place
are intersected there, weighed by IDF; a place counts if the whole key phrase is present
and the weight of the words found reaches ``least_cover`` of the template.

Words of ``COMMON`` stand in every text: they have no weight, propose nothing, and their
places are kept only in files that hold another licence word. There they are verified as
the others are, so a key phrase is present word for word. The base phrases are templates
whose key phrase is the whole phrase, so all their places are found.

Defined results: a null or empty text has no word, no label and score 0; repeated rows are
scanned each for itself; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import materialize

#: ASCII letters and digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    text: str
    key: str
    base: bool = False


# The base phrases and their labels.
BASE = [
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
]
# Opening words of licence notices, the phrase that each must hold, and its label.
NOTICES = [
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2", "apache license version 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4", "cc by sa"),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0 universal"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute this software"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
]
COMMON = {"the", "and", "in", "or", "to", "of", "is", "a", "this", "for", "with"}


def words(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(WORD), F.lit(0))


def postings(templates: list[Template]) -> list[tuple[int, str, int, bool]]:
    """(template, word, position, whether it belongs to the key phrase) of all words."""
    found = []
    for at, template in enumerate(templates):
        text, key = (re.findall(r"[a-z0-9]+", s) for s in (template.text, template.key))
        first = next(i for i in range(len(text)) if text[i:i + len(key)] == key)
        found += [(at, w, i, first <= i < first + len(key)) for i, w in enumerate(text)]
    return found


def index(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: list[Template] | None = None) -> DataFrame:
    """``row_id``, the key as ``key``, ``n_words`` and ``hits``: word and position of every licence word.

    Stored in the shared folder, which also fixes the row ids.
    """
    vocabulary = sorted({w for _, w, _, _ in postings(templates or BASE + NOTICES)})
    listed = docs.select(docs[key].alias("key"), words(docs[text]).alias("words"))
    hits = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.alias("pos")))), lambda h: h.isNotNull()
    )
    rare = F.exists("words", lambda w: w.isin([v for v in vocabulary if v not in COMMON]))
    hits = F.when(rare, hits).otherwise(F.array().cast("array<struct<word:string,pos:int>>"))
    return materialize(
        listed.select(F.monotonically_increasing_id().alias("row_id"), "key", F.size("words").cast("long").alias("n_words"), hits.alias("hits")),
        "licence-index",
    )


def scan(
    docs: DataFrame, text: str = "text", key: str = "doc_id", templates: list[Template] | None = None, least_cover: float = 0.5,
) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels and score (best cover of a template)."""
    spark, templates = docs.sparkSession, templates or BASE + NOTICES
    files = index(docs, text, key, templates)

    frequency = (
        files.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    )
    total = files.count()
    listed = spark.createDataFrame(
        [(at, w, i, k, templates[at].label, templates[at].base) for at, w, i, k in postings(templates)],
        "template int, word string, at int, in_key boolean, label string, base boolean",
    )
    of_template = Window.partitionBy("template")
    rarest = of_template.orderBy(F.col("in_key").desc(), F.col("idf").desc(), "at")
    # as many rows as the templates have words, whatever the corpus
    weighed = materialize(
        listed.join(frequency, "word", "left")
        .withColumn("idf", F.when(F.col("word").isin(sorted(COMMON)), 0.0).otherwise(F.log((F.lit(total) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1))
        .withColumn("anchor", F.row_number().over(rarest) == 1)
        .withColumn("weight", F.sum("idf").over(of_template))
        .withColumn("key_words", F.sum(F.col("in_key").cast("int")).over(of_template)).drop("df"),
        "licence-postings",
    )
    anchors = [r.word for r in weighed.where("anchor").select("word").distinct().collect()]

    looked_up = files.where(F.exists("hits", lambda h: h["word"].isin(anchors))).select("row_id", F.explode("hits").alias("hit"))
    agreed = (
        looked_up.select("row_id", "hit.word", "hit.pos").join(F.broadcast(weighed), "word")
        .groupBy("row_id", "template", (F.col("pos") - F.col("at")).alias("start"))
        .agg(
            F.sum(F.col("in_key").cast("int")).alias("found"), F.sum("idf").alias("got"), F.max("anchor").alias("anchored"),
            F.min(F.when(F.col("in_key"), F.col("pos"))).alias("pos"),
            *[F.first(c).alias(c) for c in ("label", "base", "weight", "key_words")],
        )
        .where("anchored AND found = key_words").withColumn("cover", F.least(F.col("got") / F.col("weight"), F.lit(1.0)))
        .where(F.col("cover") >= least_cover)
    )
    of_base = lambda c: F.when(F.col("base"), c)
    name = lambda found: F.concat_ws(",", F.array_sort(F.collect_set(found)))
    per_file = agreed.groupBy("row_id").agg(
        F.count(of_base(F.lit(1))).alias("n_base"), F.min(of_base(F.col("pos"))).cast("long").alias("first_word"),
        F.max(of_base(F.col("pos"))).cast("long").alias("last_word"), name(of_base(F.col("label"))).alias("base_labels"),
        name(F.col("label")).alias("labels"), F.max("cover").alias("score"),
    )
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return files.select("row_id", "key", "n_words").join(per_file, "row_id", "left").select(
        F.col("key").alias(key), "n_words",
        *[F.coalesce(F.col(c), empty[c]).alias(c) if c in empty else F.col(c) for c in per_file.columns if c != "row_id"],
    )
