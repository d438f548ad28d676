"""Quality rules with fences fitted to each language and source.

Measures of every text are taken once and stored. A mergeable quantile sketch per
language and source gives each measure's quartiles; a group with few documents takes
those of its language, whose sketch is merged from the groups', a rare language those of
the whole corpus. A document is rejected if a measure lies beyond its fence: ``width``
times the distance of the quartiles (at least the measure's ``least`` distance) outside
them. Two fixed rules of the contract, ``base_failed``, reject whatever the fences say.

Defined results: a null or empty text has no words and fails the base rules; null
languages and sources are groups of their own; repeated rows count each; columns of any
name pass through ``row`` untouched; an empty table gives an empty table. Sketches are
randomised within their error, so a document next to a fence may fall on either side.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.words import WORD
from tidegauge.session import materialize

SYMBOL = r"[#*$%&|<>]"
BLANK = r"[\x20\x09-\x0D]"
LEAST_WORDS, MOST_REPEATED = 50, 50


class Measure(NamedTuple):
    """A ratio of two counts; ``least``: the smallest distance of quartiles that is believed."""
    name: str
    over: str
    under: str
    least: float
    low: bool = False


MEASURES = [
    Measure("symbols", "n_symbols", "n_words", 0.05),
    Measure("repeated_lines", "n_dup_lines", "n_lines", 0.12),
    Measure("repeated_words", "n_repeat_words", "n_words", 0.1),
    Measure("word_length", "word_chars", "n_words", 0.5, low=True),
]
WIDTH = 4.0
LEAST_ROWS = 200
SKETCH_K = 400


def measured(docs: DataFrame, text: Column) -> DataFrame:
    """``row`` and the counts of each text.

    A word is repeated if it lies in a three-word window that occurs twice; windows are
    compared by a 64-bit hash, sorted within the row.
    """
    body = F.coalesce(text, F.lit(""))
    base = docs.select(F.struct("*").alias("row"), body.alias("body")).select(
        "row", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("body", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
        F.regexp_count("body", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.length("body") - F.regexp_count("body", F.lit(BLANK))).cast("long").alias("word_chars"),
    )
    hashed = base.select(
        "row", "words", "n_symbols", "word_chars", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    ).withColumn("windows", F.when(F.col("n_words") >= 3, F.transform(
        F.slice("words", F.lit(1), F.greatest(F.col("n_words") - 2, F.lit(1)).cast("int")),
        lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
    )))
    kept = ["row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    ordered = hashed.select(*kept, F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).alias("ordered"))
    same = lambda e, i: F.get("ordered", i)["h"] == e["h"]
    twice = ordered.select(*kept, F.sort_array(F.transform(F.filter(
        "ordered", lambda e, i: F.coalesce(same(e, i - 1), F.lit(False)) | F.coalesce(same(e, i + 1), F.lit(False))
    ), lambda e: e["i"])).alias("starts"))
    covered = F.aggregate(
        F.transform("starts", lambda at, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - at, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return twice.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ratio(m: Measure) -> Column:
    return F.col(m.over) / F.greatest(F.col(m.under), F.lit(1))


def sketches(counted: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """lang, source, rows and one sketch per measure over the documents that have words."""
    return counted.where("n_words > 0").groupBy("lang", "source").agg(
        F.count("*").alias("rows"), *[F.kll_sketch_agg_double(ratio(m), F.lit(k)).alias(m.name) for m in MEASURES]
    )


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[F.kll_merge_agg_double(m.name).alias(m.name) for m in MEASURES])


def fences(parts: DataFrame, width: float = WIDTH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """lang, source and for each measure ``<name>_low`` (null where there is none) and ``<name>_high``."""
    def quartiles(frame: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
        quartile = lambda m, q: F.kll_sketch_get_quantile_double(m.name, F.lit(q))
        return frame.select(*keys, F.col("rows").alias(f"{prefix}_rows"), F.struct(*[
            F.struct(quartile(m, 0.25).alias("low"), quartile(m, 0.75).alias("high")).alias(m.name) for m in MEASURES
        ]).alias(prefix))

    own = quartiles(parts, "own", ["lang", "source"]).withColumn("one", F.lit(1))
    lang = quartiles(merged(parts, "lang"), "of_lang", ["lang"]).withColumnRenamed("lang", "l")
    whole = quartiles(merged(parts.withColumn("one", F.lit(1)), "one"), "whole", ["one"])
    chosen = own.join(lang, F.col("lang").eqNullSafe(F.col("l"))).join(whole, "one").select("lang", "source", F.when(
        F.col("own_rows") >= least_rows, F.col("own")).when(F.col("of_lang_rows") >= least_rows, F.col("of_lang")).otherwise(F.col("whole")).alias("q"))

    def fence(m: Measure) -> list[Column]:
        q = F.col("q")[m.name]
        gap = width * F.greatest(q["high"] - q["low"], F.lit(m.least))
        return [(q["low"] - gap if m.low else F.lit(None).cast("double")).alias(f"{m.name}_low"), (q["high"] + gap).alias(f"{m.name}_high")]

    return chosen.select("lang", "source", *[c for m in MEASURES for c in fence(m)])


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True,
           width: float = WIDTH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``row`` (the document's columns, the text only if asked for), counts, base_failed, kept and ``reasons``."""
    counted = measured(docs, docs[text])
    if not keep_text:
        counted = counted.withColumn("row", F.col("row").dropFields(text))
    counted = materialize(counted.withColumn("lang", F.col("row")[lang]).withColumn("source", F.col("row")[source]), "quality-measures")
    limits = materialize(fences(sketches(counted), width, least_rows), "quality-fences")
    limits = limits.withColumnsRenamed({"lang": "l", "source": "s"})
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    beyond = [F.when((ratio(m) > F.col(f"{m.name}_high")) | F.coalesce(ratio(m) < F.col(f"{m.name}_low"), F.lit(False)), F.lit(m.name)) for m in MEASURES]
    return joined.withColumn("reasons", F.filter(F.array(F.when(base, F.lit("base")), *beyond), lambda r: r.isNotNull())).select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (F.size("reasons") == 0).alias("kept"), "reasons",
    )
