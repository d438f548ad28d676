"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every query relies on: UTC clock and adaptive plans."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def smaller_tasks(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs run inside read at most about ``size`` of shuffled data in a task, where the plan is adaptive.

    Rows of keys alike shrink many times on their way; tasks cut by the default size would
    sort gigabytes.
    """
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A session that
    runs in one process may leave it unset and gets a temporary folder; on a cluster
    executors would each write to their own disk, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidegauge/{purpose}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder made by ``workspace``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df, purpose: str, path: str | None = None):
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage on storage that outlives an executor, so a lost executor costs
    a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = path or workspace(spark, purpose)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
