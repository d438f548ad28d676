"""Blocks, runs and graphs on their own; the pipeline against a plain version."""

import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import pfor
from tidegauge.llm.graphs import components
from tidegauge.llm.suffixes import Entry, common, front_coded, merged


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=600), max_size=5))
def test_pfor_round_trip(docs):
    out = io.BytesIO()
    writer = pfor.Writer(out)
    for k, ids in enumerate(docs):
        writer.add(k, np.array(ids, np.uint32))
    writer.close()
    reader = pfor.Reader(io.BytesIO(out.getvalue()))
    assert [(k, ids.tolist()) for k, _, ids in reader.documents()] == list(enumerate(docs))
    every = [x for d in docs for x in d]
    if len(every) > 3:
        assert reader.ids(2, len(every) - 3).tolist() == every[2:-1]


def test_pfor_refuses_damage():
    out = io.BytesIO()
    writer = pfor.Writer(out)
    writer.add(1, np.arange(10, dtype=np.uint32))
    writer.close()
    data = bytearray(out.getvalue())
    data[-60] ^= 1
    with pytest.raises(ValueError):
        pfor.Reader(io.BytesIO(bytes(data)))
    with pytest.raises(ValueError):
        pfor.Reader(io.BytesIO(b"x"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=9), max_size=30), max_size=9))
def test_merged_runs_are_sorted(runs):
    entries = [[Entry(s, b"l", i, k, 3) for i, s in enumerate(r)] for k, r in enumerate(runs)]
    found = list(merged([front_coded(e) for e in entries]))
    assert sorted(e for _, e in found) == sorted(e for r in entries for e in r)
    assert [e.suffix for _, e in found] == sorted(e.suffix for _, e in found)
    assert all(shared == common(a.suffix, b.suffix) for (_, a), (shared, b) in zip(found, found[1:]))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2000 + i) for i in range(200)] + [(None, 4), (7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_pipeline_stages(spark):
    """Each stage against a plain reading of its rule, on the smallest tables."""
    import corpus_pipeline as p
    from llm.test_contracts import WORD, components as near
    from tidegauge.llm import pieces

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in p.STAGES[:-1]:
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = p.materialize(stage(spark, docs, folder), "test-stage")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(i in kept[0] for i, q in good.items() if q == 1 and len(WORD.findall(texts[i])) >= 60)
    assert all(len(WORD.findall(t)) >= 50 for t in kept[0].values())
    assert set(kept[1]) == {i for i, _, c in near(sorted(kept[0].items())) if i == c}
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert set(kept[2]) == {i for i, t in kept[1].items() if not any(x in " ".join(t.split()) for x in items)}
    library = pieces.load()
    got = p.STAGES[-1][1](spark, docs, folder).collect()
    assert sum(r.n_tokens for r in got) == sum(len(library.encode(r.text).ids) + 1 for r in docs.collect())


def test_pipeline_on_odd_and_empty_rows(spark, folder, empty_folder):
    import corpus_pipeline as p

    assert p.run(spark, empty_folder).collect() == []
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(p.run(spark, folder).columns)
