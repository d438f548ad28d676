import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidegauge.operators.quantiles import (
    MOST_VALUES, counted, interpolated_percentiles, ranges_at_ranks, rank_percentiles, upper_median, values_at_ranks,
)
from tidegauge.session import materialize


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 == 0 else f"k{i % 40}"
        rows.append((key, rng.choice([rng.gauss(0, 100), rng.expovariate(0.001), float(rng.randrange(5)), 0.0])))
    return rows, spark.createDataFrame(rows, "key string, v double").repartition(8)


def groups(rows):
    out = {}
    for k, v in rows:
        out.setdefault(k, []).append(v)
    return {k: sorted(v) for k, v in out.items()}


def test_upper_median(data):
    rows, df = data
    got = {r["key"]: (r["n"], r["p50"]) for r in upper_median(df, ["key"], "v").collect()}
    assert got == {k: (len(v), v[len(v) // 2]) for k, v in groups(rows).items()}


def test_rank_percentiles(data):
    rows, df = data
    got = {r["key"]: (r["a"], r["b"]) for r in rank_percentiles(df, ["key"], "v", {"a": 0.95, "b": 0.0}).collect()}
    assert got == {k: (v[int(len(v) * 0.95)], v[0]) for k, v in groups(rows).items()}


def test_interpolated(data):
    rows, df = data
    for r in interpolated_percentiles(df, ["key"], "v", {"p": 0.9, "q": 0.999}).collect():
        v = groups(rows)[r["key"]]
        assert r["p"] == pytest.approx(np.percentile(v, 90))
        assert r["q"] == pytest.approx(np.percentile(v, 99.9))


def test_nulls_and_single_rows(spark):
    df = spark.createDataFrame([("a", None), ("a", 3.0), ("b", None)], "key string, v double")
    assert [(r["key"], r["p50"]) for r in upper_median(df, ["key"], "v").collect()] == [("a", 3.0)]


@pytest.mark.parametrize("most", [1, 3, 50])
def test_small_ranges(data, most):
    rows, df = data
    ranks = {"first": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "next": lambda n: F.floor(n / 2) + 1, "last": lambda n: n - 1}
    got = {r["key"]: (r["first"], r["mid"], r["next"], r["last"]) for r in values_at_ranks(df, ["key"], "v", ranks, most=most).collect()}
    assert got == {k: (v[0], v[len(v) // 2], v[len(v) // 2 + 1], v[-1]) for k, v in groups(rows).items()}


def test_many_values_close_together(spark):
    """A million distinct values within a thousandth of an octave: no task sorts more than the bound."""
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select(F.lit("a").alias("key"), (1 + F.col("id") * 5e-10).alias("v"))
    got = rank_percentiles(df, ["key"], "v", {"a": 0.5, "b": 0.999}).first()
    assert (got["n"], got["a"], got["b"]) == (n, 1 + n // 2 * 5e-10, 1 + int(n * 0.999) * 5e-10)
    hist = materialize(counted(df, ["key"], "v"), "values")
    want = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rank).cast("bigint").alias("rank")) for name, rank in (("a", n // 2), ("b", int(n * 0.999)))])
    wide = hist.groupBy("key").agg(F.count(F.lit(1)).alias("_d")).withColumn("_want", want)
    held = ranges_at_ranks(hist, wide, ["key"]).collect()
    assert len(held) == 2 and all(r["_d"] <= MOST_VALUES for r in held)
