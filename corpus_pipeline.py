"""The corpus pipeline: five stages over ``documents``, each stored and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents, whatever these are. Rows without a doc_id
go through under an id made from their text. Of rows that share a doc_id the one whose text
has the smallest hash keeps it, others go through under an id made from both; equal rows
are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.decontamination import leaks
from tidegauge.llm.jaccard import near_duplicates
from tidegauge.llm.mixing import mixed
from tidegauge.llm.q9_token_files import digest
from tidegauge.llm.quality import judged
from tidegauge.llm.tables import table
from tidegauge.session import discard, materialize, workspace


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` with all columns, and an id that is never null and that no other text has; made-up ids lie above 2**61."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("bigint").alias("doc"), docs["text"].alias("text"), digest.alias("digest"))
    made = F.lit(1 << 61) + F.xxhash64("doc", "digest").bitwiseAND((1 << 61) - 1)
    ids = rows.where("doc IS NOT NULL").groupBy(F.col("doc").alias("_doc")).agg(F.min("digest").alias("_first"), F.max("digest").alias("_last"))
    shared = materialize(ids.where("_first < _last").select("_doc", "_first"), "pipeline-shared-ids")  # ids of two texts
    met = rows.join(shared, F.col("doc") == F.col("_doc"), "left")
    own = F.col("doc").isNotNull() & (F.col("_first").isNull() | (F.col("digest") == F.col("_first")))
    return met.select("row", F.when(own, F.col("doc")).otherwise(made).alias("id"), "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the fences of their language and source reject."""
    return judged(docs).where("kept").select("row.*")


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each near-duplicate component."""
    keyed = _keyed(docs)
    groups = near_duplicates(keyed.select("id", "text"), key="id")
    stay = materialize(groups.where("id = component_id").select("id").distinct(), "pipeline-kept")
    left = keyed.join(stay, "id", "left_semi")
    again = F.row_number().over(Window.partitionBy("id").orderBy(F.lit(0)))  # equal rows; cut before they are shuffled
    return left.withColumn("again", again).where("again = 1").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark questions."""
    keyed = _keyed(docs)
    found = materialize(leaks(keyed.select("id", "text"), table(spark, sf_dir, "benchmark"), key="id").select("id"), "pipeline-leaks")
    return keyed.join(found, "id", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source comes near its target."""
    return mixed(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files; returns doc_id, start, n_tokens and ids_crc32 of every document in them."""
    return digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_per_group),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_output),
]

#: Quantile sketches and byte-pair encoding have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = workspace(spark, "pipeline-stage")
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-stage", folder)
        if before is not None:
            discard(spark, before)  # only the newest copy of the corpus is kept
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
