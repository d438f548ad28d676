"""Mixing sources to target weights by systematic sampling.

A source's rate is its target over its size. Documents of a source stand in one fixed
order; the prefix sum of expected copies is then place times rate, one offset per source
is added, and a document is emitted once per integer boundary its step crosses: floor or
ceiling of the rate, never more. Documents are ordered by size, so every range of sizes
is sampled at the rate and the words taken come near the target.

Places are found without sorting a source: documents fall into buckets by the leading
bits of their size, full buckets are split by a hash of the id into parts of about
``part_rows`` rows, only such parts are sorted, and each part's first place is a running
sum over the small table of parts. Rates are fixed-point numbers with 20 fraction bits,
so prefix sums are exact and reruns agree.

Defined results: a null text has size 0; a source without words has target 0 and its
documents are not taken; a null source is a source of its own and the last one; equal
sizes stand in the order of ids, null ids first; repeated rows are documents of their
own; columns of any name pass through ``row`` untouched; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.words import n_words
from tidegauge.session import materialize

ONE = 1 << 20
PART_ROWS = 4096
MAX_COPIES = 3
WEIGHTS = (1, 2, 3)


def sources_key(source: Column) -> Column:
    """A key that is never null and sorts as the source does, null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source))


def hashed(text: Column) -> Column:
    """32 bits of a hash that every SQL engine has."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """skey, source_size -> target and rate; one row per source.

    Shares grow with one common level until they meet ``max_copies`` times the source's
    size. Sources meet it in the order of that limit over their weight.
    """
    order = Window.orderBy("skey")  # one row per source
    weighed = totals.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    ).withColumn("most", F.col("source_size") * max_copies)
    met = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    upto = met.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.sum("most").over(upto) + F.col("most")) / (
        F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight")
    )
    # the level that holds for all sources from this one on, if this one is not capped
    levelled = weighed.withColumn("level", level.cast("double")).withColumn("place", F.row_number().over(met))
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))).over(every)["level"]
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("free"))
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * ONE)).otherwise(0)
    return (
        levelled.withColumn("free", free)
        .withColumn("target", F.coalesce(target, F.col("most").cast("double"))).withColumn("rate", rate.cast("long"))
        .select("skey", "source_size", "target", "rate")
    )


def mixed(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", size: Column | None = None,
    part_rows: int = PART_ROWS, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix",
    digest: Column | None = None,
) -> DataFrame:
    """``row`` (all columns of the document), size, source_size, target and copies (how often it is emitted).

    Rows are dealt to parts by key and text (``digest``: a hash of it that is there already),
    so rows without a key, or of one key, are spread too.
    """
    cast = F.col("row")[key].cast("string")
    digest = F.md5(F.coalesce(docs[text].cast("string"), F.lit(""))) if digest is None else digest
    sized = docs.select(F.struct("*").alias("row"), (n_words(docs[text]) if size is None else size).alias("size"), sources_key(docs[source]).alias("skey"), digest.alias("digest"))
    spare = F.greatest(F.length(F.bin("size")) - 4, F.lit(0))
    sized = sized.withColumn("bucket", spare * 16 + F.call_function("shiftright", F.col("size"), spare))
    sized = sized.withColumn("h", hashed(F.concat_ws("|", F.coalesce(cast, F.lit("")), "digest"))).drop("digest")

    # sizes are counted once for all sums; the two tables that rows meet are stored, so their size decides how they are joined
    small = materialize(sized.select("skey", "size", "bucket", "h"), "mix-small")
    buckets = small.groupBy("skey", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    wanted = targets(buckets.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, max_copies)
    split = materialize(buckets.select("skey", "bucket", F.ceil(F.col("n") / part_rows).cast("long").alias("parts")), "mix-split")
    counted = (
        small.groupBy("skey", "bucket", "h").agg(F.count("*").alias("n"))  # combined before the shuffle
        .join(split, ["skey", "bucket"]).groupBy("skey", "bucket", (F.col("h") % F.col("parts")).alias("part"), "parts").agg(F.sum("n").alias("n"))
    )
    before = Window.partitionBy("skey").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        counted.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).join(wanted, "skey")
        .withColumn("offset", hashed(F.concat(F.lit(seed), "skey")) % ONE)
    )
    parts = materialize(parts.drop("parts", "n"), "mix-parts")
    within = Window.partitionBy("skey", "bucket", "part").orderBy("size", F.col("row")[key])
    placed = (
        sized.join(split, ["skey", "bucket"]).withColumn("part", F.col("h") % F.col("parts")).drop("parts")
        .join(parts, ["skey", "bucket", "part"])
        .withColumn("place", F.col("first") + F.row_number().over(within))
    )
    step = lambda place: F.shiftright(place * F.col("rate") + F.col("offset"), 20)
    return placed.select("row", "size", "source_size", "target", (step(F.col("place")) - step(F.col("place") - 1)).alias("copies"))
