import random

import pytest

from tidegauge.llm.queries import load

WORDS = "the of and in ter ing anda thero blesh onred tionan wher ist edes orth".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, copies int, row string, key string, bucket int, score double, words string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, shared ids, columns of clashing names."""
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(6)]
    long = "\n".join(prose(rng, 40) for _ in range(300))
    texts = [
        (1, base[0]), (2, base[0]), (3, base[0] + " tail"), (4, base[1]), (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "ONE"),
        (10, long), (11, long[:20000] + " changed " + long[20000:]), (12, "a " * 400), (13, base[2] + "\n\n" + base[2]), (None, base[3]), (None, base[3]),
        (14, base[4]), (14, base[4]), (15, base[5]), (15, prose(rng, 90)), (16, "x" * 5000), (17, "ÀÉ ſ K İ 漢字 <|endoftext|> 'll we're  two"),
        (18, base[1][:200] + base[4]), (19, prose(rng, 49)), (20, prose(rng, 50)), (21, "### $$$ " * 60), (22, "don't   　x \r\n y"),
    ]
    out = []
    for i, (doc, text) in enumerate(texts):
        out.append((doc, text, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None, i, i, "r", "k", i, 0.5, "w"))
    return out


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def queries():
    return load()[0]


@pytest.fixture(scope="session")
def folder(tmp_path_factory, spark, odd):
    """A folder of tables whose documents are the odd ones."""
    place = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(1, 20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(0, "short one"), (1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame(
        [(1, "u", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "a b", None), (4, "c", ""), (None, "d", "<p>x</p>"), (5, "e", "y" * 200_000), (5, "e", "y" * 200_000)],
        "page_id bigint, url string, html string",
    ).write.parquet(f"{place}/pages.parquet")
    odd_vectors(spark).write.parquet(f"{place}/embeddings.parquet")
    return str(place)


def odd_vectors(spark):
    """Null vectors, components that are null or not finite, other lengths, ties, repeated and null keys, clashing columns."""
    rng, nan, inf = random.Random(9), float("nan"), float("inf")
    vectors = [[rng.choice([-0.5, -0.25, 0.0, 0.25, 0.75]) + rng.choice([0.0, 0.0, 0.0003]) for _ in range(8)] for _ in range(300)]
    rows = [(i, v, i % 4 if i % 5 else None, "c", -1) for i, v in enumerate(vectors)]
    rows += [(7, vectors[7], 2, None, 0), (7, vectors[9], 2, None, 0), (None, vectors[3], None, None, None), (None, vectors[4], 1, "x", 1)]
    rows += [(400, None, 1, "", 0), (401, [nan] + vectors[0][1:], 1, "", 0), (402, [inf] + vectors[0][1:], 1, "", 0), (403, [None] + vectors[0][1:], 1, "", 0),
             (404, [0.5] * 5, 1, "", 0), (405, [], 1, "", 0), (-3, [0.1] * 8, 9, "", 0), (406, [-inf] * 8, None, "", 0), (407, [300000.0] * 8, 9, "", 0)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, code string, error int").repartition(3)


@pytest.fixture(scope="session")
def empty_folder(tmp_path_factory, spark, none):
    place = tmp_path_factory.mktemp("none")
    none.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{place}/pages.parquet")
    odd_vectors(spark).where("vec_id > 1000").write.parquet(f"{place}/embeddings.parquet")
    return str(place)
