"""Exact order statistics per group; no task sorts more than a bounded number of distinct values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import materialize

#: Distinct values that one task sorts; parts that a larger range of values is cut into.
MOST_VALUES, PARTS = 1 << 16, 64
#: Accuracy of the sketch that gives split points: a part is at most a little more than its share.
ACCURACY = 4096
#: Every round cuts a range by ``PARTS``; more rounds than this mean that values do not compare.
ROUNDS = 12


def counted(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Equal values counted per group (``_v``, ``_c``), and totals of other columns; rows with a null value or key are ignored."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, value]])
    return df.filter(present).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(name) for name, c in (sums or {}).items()])


def ranges_at_ranks(hist: DataFrame, groups: DataFrame, keys: list[str], most: int = MOST_VALUES) -> DataFrame:
    """Per group the ranges of values that hold its wanted ranks: ``_lo``, ``_hi``, ``_before`` (rows below), ``_want``.

    ``groups`` has, besides the keys, the number of distinct values ``_d`` and ``_want``. A
    range of more than ``most`` values is cut at points of a sketch of its values, parts
    that hold no wanted rank are left, and so on until every range is small enough.
    """
    every = F.lit(None).cast(hist.schema["_v"].dataType)
    held = groups.select(*keys, every.alias("_lo"), every.alias("_hi"), F.lit(0).cast("bigint").alias("_before"), "_d", "_want")
    done = None
    for _ in range(ROUNDS):
        small = held.filter(F.col("_d") <= most)
        done = small if done is None else done.unionByName(small)
        large = held.filter(F.col("_d") > most)
        if large.isEmpty():
            return done
        rows = _inside(hist, large, keys)
        points = [i / PARTS for i in range(1, PARTS)]
        split = rows.groupBy(*keys, "_lo").agg(F.array_distinct(F.percentile_approx("_v", points, ACCURACY)).alias("_points"))
        cut = _same(rows, split, [*keys, "_lo"]).withColumn("_part", F.size(F.filter("_points", lambda p: p <= F.col("_v"))))
        parts = cut.groupBy(*keys, "_lo", "_part").agg(
            F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_first"), F.max("_v").alias("_last"),
            F.any_value("_before").alias("_before"), F.any_value("_want").alias("_want"))
        upto = Window.partitionBy(*keys, "_lo").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most PARTS rows
        parts = parts.withColumn("_upto", F.col("_before") + F.sum("_n").over(upto)).withColumn("_before", F.col("_upto") - F.col("_n"))
        kept = F.filter("_want", lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_upto")))
        parts = parts.withColumn("_want", kept).filter(F.size("_want") > 0)
        held = materialize(parts.select(*keys, F.col("_first").alias("_lo"), F.col("_last").alias("_hi"), "_before", "_d", "_want"), "ranges")
    raise RuntimeError("values of one group do not split")


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_r{c}" for c in columns})
    return left.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in columns])).drop(*[f"_r{c}" for c in columns])


def _inside(hist: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each range."""
    met = hist.select(*keys, "_v", "_c").join(ranges, keys)
    return met.filter((F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi"))))


def values_at_ranks(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]],
    sums: dict[str, Column] | None = None, most: int = MOST_VALUES,
) -> DataFrame:
    """Per group, the values at zero-based ranks that depend on the group size ``n``.

    Equal values are counted first, combined before the shuffle, and stored; a group of
    few distinct values is sorted as it is, of a larger one only the ranges that hold a
    wanted rank. ``sums`` adds totals of other columns per group in the same pass.
    """
    sums = sums or {}
    hist = materialize(counted(df, keys, value, sums), "values")
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("bigint").alias("rank")) for name, f in ranks.items()]
    )
    groups = hist.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("_d"), *[F.sum(name).alias(name) for name in sums])
    groups = materialize(groups.withColumn("_want", wanted), "groups")
    rows = _inside(hist, ranges_at_ranks(hist, groups, keys, most), keys)
    inside = Window.partitionBy(*keys, "_lo").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = (
        rows.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
        .withColumn("_w", F.explode("_want"))
        .filter((F.col("_w.rank") >= F.col("_upto") - F.col("_c")) & (F.col("_w.rank") < F.col("_upto")))
    )
    found = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_w.name") == name, F.col("_v"))).alias(name) for name in ranks])
    return groups.select(*keys, "n", *sums).join(found, keys)


def upper_median(
    df: DataFrame, keys: list[str], value: str, out: str = "p50", sums: dict[str, Column] | None = None
) -> DataFrame:
    """``sorted[n // 2]`` of every group."""
    return values_at_ranks(df, keys, value, {out: lambda n: F.floor(n / 2)}, sums)


def rank_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """``sorted[int(n * p)]`` of every group."""
    return values_at_ranks(
        df, keys, value,
        {name: (lambda n, p=p: F.least(F.floor(n * p), n - 1)) for name, p in points.items()},
    )


def interpolated_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles at position ``p * (n - 1)``."""
    ranks = {}
    for name, p in points.items():
        ranks[f"{name}_lo"] = lambda n, p=p: F.floor((n - 1) * p)
        ranks[f"{name}_hi"] = lambda n, p=p: F.ceil((n - 1) * p)
    found = values_at_ranks(df, keys, value, ranks)
    out = [*keys, "n"]
    for name, p in points.items():
        position = (F.col("n") - 1) * p
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return found.select(*out)
