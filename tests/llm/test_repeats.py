"""Periodic runs, word windows and vector codes against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(x, least=12):
    best = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            a = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            if i - a >= max(p, least - p):
                best.setdefault((a, i + p), p)
            i += i == a or i + p < len(x)
    return sorted((a, e - a, p) for (a, e), p in best.items())


def sequences():
    rng = random.Random(1)
    for kind in range(600):
        n = rng.randrange(0, 130)
        if kind % 5 == 0:
            yield [rng.randrange(2) for _ in range(n)]
        elif kind % 5 == 1:
            yield [rng.randrange(6) for _ in range(n)]
        elif kind % 5 == 2:  # a periodic stretch between others
            unit = [rng.randrange(30) for _ in range(rng.randrange(1, 40))]
            yield [rng.randrange(30) for _ in range(9)] + [unit[i % len(unit)] for i in range(n)] + [rng.randrange(30) for _ in range(9)]
        elif kind % 5 == 3:
            yield [1] * n
        else:  # no cube, many squares, and names of doubled length that differ in every bit
            word = [0]
            while len(word) < n:
                word = [y for x in word for y in ((0, 1) if x == 0 else (1, 0) if rng.random() < 0.95 else (1, 1))]
            yield word


@pytest.mark.parametrize("least", [2, 7, 12])
def test_catchers_word_by_word_and_at_once(least):
    from tidegauge.llm.squares import Catchers

    rng, names = random.Random(2), np.random.default_rng(3).integers(0, 1 << 63, 40).astype(np.uint64)
    for x in sequences():
        codes, found = names[np.array(x, np.int64)] if x else np.empty(0, np.uint64), []
        for sizes in ([len(x)], [1], [1, 2, 7, 40]):
            catchers, at = Catchers(max(1, len(x)), least=least), 0
            while at < len(x):
                step = rng.choice(sizes)
                catchers.append(codes[at:at + step])
                at += step
            found.append([(a, e - a, p) for a, e, p in catchers.runs().tolist()])
        assert found[0] == found[1] == found[2] == brute_runs(x, least), x


def test_runs_of_many_texts_share_a_stream():
    from tidegauge.llm import periodic_runs

    texts = [[str(w).encode() for w in x] for x in sequences()] + [[b"a", b"b"] * 4000, [], [b"x"] * 11, [b"x"] * 12]
    got = periodic_runs.runs_of(texts)
    assert [sorted(map(tuple, r.tolist()), key=lambda r: (r[0], r[2])) for r in got[:-4]] == [sorted(brute_runs(t), key=lambda r: (r[0], r[2])) for t in texts[:-4]]
    assert [r.tolist() for r in got[-4:]] == [[[0, 8000, 2]], [], [], [[0, 12, 1]]]


def planted(doc, text):
    w = words_of(text)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def run_row(doc, text):
    w = planted(doc, text)
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc, len(runs), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def digests(rows):
    return [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows]


def test_periodic_runs(spark, queries, folder, odd_rows):
    got = collections.Counter(digests(queries["op11_periodic_runs"](spark, folder).collect()))
    small = [(r[0], r[1]) for r in odd_rows if len(words_of(r[1])) < 3000]  # brute force is quadratic
    want = collections.Counter(run_row(*r) for r in small)
    assert sum(got.values()) == len(odd_rows) and not want - got and any(r[0] for r in want)


def test_periodic_runs_are_planted(spark, tmp_path, queries):
    rng = random.Random(4)
    rows = [(i, " ".join(str(rng.randrange(50)) for _ in range(rng.randrange(0, 90)))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = digests(queries["op11_periodic_runs"](spark, str(tmp_path)).collect())
    assert sorted(got) == sorted(run_row(*r) for r in rows) and sum(r[1] > 0 for r in got) > 5


def windows(rows, size=50):
    """(n_words, n_removed, sha of what is left) of every (id, text), in their order."""
    last, first, texts = 1 << 63, {}, [(d, words_of(t)) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            first[k] = min(first.get(k, last), last if d is None else d)
    for d, w in texts:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < (last if d is None else d):
                gone |= set(range(i, i + size))
        yield d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


def shared_passages(seed=6, n=60):
    """Texts over a small vocabulary with passages, copies and near copies of each other."""
    rng = random.Random(seed)
    some = lambda n: [str(rng.randrange(400)) for _ in range(n)]
    pool, rows = [some(rng.randrange(40, 140)) for _ in range(6)], []
    for i in range(n):
        w = some(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            passage = rng.choice(pool)
            a = rng.randrange(0, 20)
            w += passage[a:len(passage) - rng.randrange(0, 20)] + some(rng.randrange(0, 30))
        if rows and rng.random() < 0.2:
            w = words_of(rng.choice(rows)[1])
            if w and rng.random() < 0.5:
                w[rng.randrange(len(w))] = "changed"
        rows.append((None if rng.random() < 0.05 else rng.randrange(50), rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(99, "same words " * 200), (98, "same words " * 200 + "end"), (97, None), (97, "")]


@pytest.mark.parametrize("hot", [20_000, 0])
def test_word_windows(spark, hot):
    from tidegauge.llm.window_trees import deduplicated

    rows = shared_passages()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in deduplicated(docs, hot=hot).collect())
    assert got == collections.Counter((d, n, gone, sha(left)) for d, n, gone, left in windows(rows))
    kept = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in deduplicated(docs, hot=hot, keep_text=True).collect())
    assert kept == collections.Counter(windows(rows))


def test_word_windows_of_odd_rows(spark, queries, folder, odd_rows):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries["op12_substring_dedup"](spark, folder).collect())
    assert got == collections.Counter((d, n, gone, sha(left)) for d, n, gone, left in windows([r[:2] for r in odd_rows]))


def test_subtrees_in_bundles_of_any_size(spark):
    from tidegauge.llm.window_trees import deduplicated, suffixes, trees

    rows = shared_passages(8, 20)
    texts = [(i, i, t or "", [(0, p) for p in range(0, max(0, len(words_of(t)) - 15), 7)]) for i, (_, t) in enumerate(rows)]
    made = suffixes(spark.createDataFrame(texts, "row bigint, doc bigint, text string, wanted array<struct<gram:bigint,pos:int>>"))
    leaves = made.groupBy("gram", "leaf", "before", "suffix").agg({"doc": "min"}).withColumnRenamed("min(doc)", "low").selectExpr("*", "low + 100 AS high")
    leaves = leaves.selectExpr("abs(hash(substring_index(suffix, ' ', 16))) AS gram", "leaf", "before", "suffix", "low", "high")
    every = [collections.Counter((bytes(r.leaf), tuple(r.found)) for r in trees(leaves, bundle=b).collect()) for b in (1, 3, 10**6)]
    assert every[0] == every[1] == every[2] and every[0]


def brute_codes(rows, entries=256):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(order[0][1])
    kept = [(k, [math.floor(1024 * x) for x in v], label) for k, v, label in kept if len(v) == dims]
    w = dims // 4
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * w:p * w + w] for r in order] for p in range(4)]

    def near(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(4):
        for p, book in enumerate(books):
            members = collections.defaultdict(list)
            for _, v, _ in kept:
                members[near(v[p * w:p * w + w], book)[0]].append(v[p * w:p * w + w])
            for e, vs in members.items():
                book[e] = [sum(c) // len(vs) for c in zip(*vs)]
    out = []
    for k, v, label in kept:
        found = [near(v[p * w:p * w + w], books[p]) for p in range(4)]
        out.append((k, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), label))
    total = collections.Counter()
    for r in out:
        total[r[3]] += r[2]
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return collections.Counter((k, code, error, total[label], digest) for k, code, error, label in out)


def test_vector_codes(spark, queries, folder):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = collections.Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in queries["op13_vector_codes"](spark, folder).collect())
    assert got == brute_codes(rows)


def test_vector_codes_of_few_and_large_vectors(spark):
    from tidegauge.llm.vector_codes import compressed

    schema = "vec_id bigint, embedding array<double>, label int"
    rows = [(1, [1e9, -1e9, 0.5, 3e12], 1), (2, [1e9, 2e9, 0.5, -3e12], 1), (3, [-1e9, 2e9, 0.25, 1.0], None)]
    got = compressed(spark.createDataFrame(rows, schema), entries=2)
    want = brute_codes(rows, 2)
    assert {(r.key, r.code, r.error) for r in got.rows.collect()} == {(k, c, min(e, (1 << 63) - 1)) for k, c, e, _, _ in want}
    bound = compressed(spark.createDataFrame([(1, [1e300] * 4, 1), (2, [-1e300] * 4, 1)], schema), entries=1)
    assert {(r.key, r.code, r.error) for r in bound.rows.collect()} == {(1, "00000000", (1 << 63) - 1), (2, "00000000", (1 << 63) - 1)}
    empty = compressed(spark.createDataFrame([(1, [], 1), (2, [], 2)], schema))
    assert {(r.key, r.code, r.error) for r in empty.rows.collect()} == {(1, "00000000", 0), (2, "00000000", 0)}
    uneven = compressed(spark.createDataFrame([(i, [float(i)] * 6, 1) for i in range(5)], schema))
    assert [b.shape for b in uneven.books] == [(5, 2), (5, 2), (5, 1), (5, 1)] and uneven.rows.where("error = 0").count() == 5


def test_distances_from_dictionaries():
    from tidegauge.llm.vector_codes import nearest

    rng = np.random.default_rng(5)
    for most in (9, 1 << 20, 1 << 40):
        vectors, entries = rng.integers(-most, most, (3000, 3)), rng.integers(-most, most, (20, 3))
        pairs = [np.unique(c, return_inverse=True) for c in vectors.T]
        index, least = nearest([v for v, _ in pairs], [c for _, c in pairs], entries, len(vectors))
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)) for e in entries] for v in vectors[:200]]
        assert [int(x) for x in index[:200]] == [d.index(min(d)) for d in exact] and [int(x) for x in least[:200]] == [min(d) for d in exact]


@pytest.mark.parametrize("share", [32 << 20, 64])
def test_bytes_in_shares_of_any_size(spark, monkeypatch, share):
    from tidegauge.llm import substrings

    monkeypatch.setattr(substrings, "SHARE_BYTES", share)
    rows = shared_passages(11, 40)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in substrings.deduplicated(docs).collect())
    last, first = 1 << 63, {}
    for d, t in rows:
        body = (t or "").encode()
        for i in range(len(body) - 49):
            first[body[i:i + 50]] = min(first.get(body[i:i + 50], last), last if d is None else d)
    want = collections.Counter()
    for d, t in rows:
        body, gone = (t or "").encode(), set()
        for i in range(len(body) - 49):
            if first[body[i:i + 50]] < (last if d is None else d):
                gone |= set(range(i, i + 50))
        left = bytes(b for i, b in enumerate(body) if i not in gone)
        want[(d, len(body), len(gone), hashlib.sha256(left).hexdigest())] += 1
    assert got == want
    assert [substrings.shares_of(n) for n in (10**9, 50 * 10**9)] == ([256, 2048] if share > 64 else [1 << 20] * 2)
