"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import discard, materialize, workspace


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) of every node that has an edge.

    Each round hooks every node to its smallest neighbour if that is smaller, shortens
    the chains of hooks by joining the hook table with itself, and replaces the ends of
    edges by their roots; edges within a root go. Every table is stored, so a lost
    executor costs one step. Null ends and loops link nothing.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    folders: list[str] = []

    def stored(frame: DataFrame) -> DataFrame:
        folders.append(workspace(spark, "components"))
        return materialize(frame, "components", folders[-1])

    rest = stored(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    roots = stored(nodes.withColumn("root", F.col("node")))
    for _ in range(most_rounds):
        if rest.isEmpty():
            break
        hooks = stored(rest.groupBy("b").agg(F.min("a").alias("to")).withColumnRenamed("b", "from"))
        while True:
            onward = hooks.select(F.col("from").alias("to"), F.col("to").alias("next"))
            hooks = stored(hooks.join(onward, "to", "left").select("from", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            if hooks.where("moved").isEmpty():
                break
            hooks = hooks.drop("moved")
        hooks = hooks.select("from", "to")
        roots = stored(roots.join(hooks, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root")))
        first = rest.join(hooks, F.col("a") == F.col("from"), "left").select(F.coalesce("to", "a").alias("a"), "b")
        both = first.join(hooks, F.col("b") == F.col("from"), "left").select("a", F.coalesce("to", "b").alias("b"))
        rest = stored(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    else:
        raise RuntimeError(f"edges are left after {most_rounds} rounds")
    for folder in folders:
        if not any(folder in f for f in roots.inputFiles()):
            discard(spark, folder)
    return roots
