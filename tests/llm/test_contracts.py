"""Each query on odd rows and on empty tables, against brute force."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from tidegauge.llm import pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return df.collect()


def multiset(found):
    return collections.Counter(found)


def test_empty_tables(spark, queries, empty_folder):
    for name, query in queries.items():
        assert query(spark, empty_folder).collect() == [], name


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if count[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark, queries, folder, odd_rows):
    got = multiset((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows(queries["op1_quality"](spark, folder)))
    assert got == multiset((r[0], *quality(r[1])) for r in odd_rows)
    assert not any(r.kept and r.base_failed for r in rows(queries["op1_quality"](spark, folder)))


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licences(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark, odd):
    from tidegauge.llm.licenses import scan

    texts = [
        "Licensed under the Apache License, Version 2.0. The MIT license; the mit License", "gnu general general public license gnu GENERAL public-license",
        "cc by cc by cc", "Released under CC BY-NC 4.0", None, "", "mit", "apache  licenses", "This work is licensed under the GNU General Public License, version 3",
        "apache license " * 3000,
    ]
    got = {r.doc_id: r for r in rows(scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")))}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licences(text), text
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[3].labels == "cc-by,cc-by-nc" and "gpl-3.0" in got[8].labels and got[0].labels == "apache,apache-2.0,mit"
    assert scan(odd).count() == odd.count()


def test_warc(spark, queries, folder):
    from tidegauge.llm.warc import round_trip

    pages = [(1, "<p>x</p>"), (2, "<p>x</p>"), (3, ""), (4, ""), (None, "<p>x</p>"), (5, "y" * 200_000), (5, "y" * 200_000)]
    first = {"<p>x</p>": 1, "": 3, "y" * 200_000: 5}
    want = multiset(
        (i, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first[h] == i else "revisit", None if first[h] == i else first[h], None)
        for i, h in pages)
    got = rows(queries["op3_warc"](spark, folder))
    assert multiset((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem) for r in got) == want
    read, _ = round_trip(spark.read.parquet(f"{folder}/pages.parquet"), min_bytes=9)
    assert all(r.record_type == "response" for r in rows(read) if r.payload_bytes < 9)
    assert {bytes(r.payload) for r in rows(read) if r.payload is not None} == {h.encode() for h in first}


def test_warc_reports_damage():
    import io
    import struct

    import zstandard

    from tidegauge.llm import warc

    good = warc.record(7, "http://a/", b"body", None, warc.digest(b"body"))
    pack = zstandard.ZstdCompressor().compress
    assert warc.parse(good)[-1] is None
    assert "digest" in warc.parse(good.replace(b"body", b"ydob"))[-1]
    assert "bytes" in warc.parse(good[:-6] + good[-4:])[-1]
    assert warc.parse(good.replace(b"WARC-Date", b"X-Date"))[-1] == "no warc-date"
    assert warc.parse(b"junk")[-1]
    found = list(warc.records(io.BytesIO(pack(good) + pack(good)[:-5])))
    assert found[0][-1] is None and "cut off" in found[1][-1]
    raw = struct.pack("<II", warc.DICTIONARY_FRAME, 3) + b"abc"  # a dictionary of raw content
    assert list(warc.records(io.BytesIO(raw + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"abc")).compress(good)), chunk=7))[0][-1] is None


def test_token_counts(spark, odd, odd_rows):
    from tidegauge.llm import token_counts as tc

    library = pieces.load()
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    got = rows(tc.prefix_counts(odd, budgets=(5, 1024)))
    assert multiset((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == multiset((r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in odd_rows)
    table = tc.PrefixTable(pieces.default_path())
    for text in ("we're 'll  two \n\n lines\t<|endoftext|>x", "ÀÉ 漢字 　  a", "  lead", "aaaaaaaaaaaaaaaa" * 20):
        changes = table.table(text)
        for i in range(len(text) + 1):
            assert tc.tokens_at(changes, len(text[:i].encode())) == count(text[:i]), text[:i]
        cut = tc.longest_within(changes, 3)
        fits = [k for k in range(len(changes) + 1) if tc.tokens_at(changes, k) <= 3]
        assert cut == max(fits)
    from pyspark.sql import functions as F

    stored = tc.prefix_counts(odd).where("doc_id = 17").select(tc.tokens_of_prefix(F.col("prefix_table"), F.col("n_bytes")).alias("n"), "n_tokens").first()
    assert stored.n == stored.n_tokens


def test_token_files(spark, queries, folder, odd_rows):
    library, start, want = pieces.load(), 0, []
    for r in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(rows(queries["op9_token_files"](spark, folder)), key=lambda r: r.start)
    assert multiset((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == multiset(want)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    for r in got:
        assert r.start == start
        start += r.n_tokens


def test_mixing(spark, queries, folder, odd_rows):
    size = {}
    for r in odd_rows:
        size[r[3]] = size.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    got = rows(queries["op8_mixing"](spark, folder))
    assert multiset((r.doc_id, r.size) for r in got) == multiset((r[0], len(WORD.findall(r[1] or ""))) for r in odd_rows)
    assert all(0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    by = {r.source_size: r.target for r in got}
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in order:
        assert by[size[s]] == pytest.approx(3 * size[s] if s in capped else level * weight[s])
    again = rows(queries["op8_mixing"](spark, folder))
    assert multiset(map(tuple, got)) == multiset(map(tuple, again))


def components(items, percent=80):
    """Smallest id reachable, by comparing all pairs."""
    sets = []
    for _, text in items:
        w = WORD.findall((text or "").translate(LOW))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(items)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            same = items[i][0] is not None and items[i][0] == items[j][0] and sets[i] and sets[j]
            both = len(sets[i] & sets[j])
            if same or sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(items):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return [(k, len(s), (least.get(root(i), k) if s else k)) for i, ((k, _), s) in enumerate(zip(items, sets))]


def test_jaccard_on_odd_rows(spark, queries, folder, odd_rows):
    got = rows(queries["op7_jaccard_join"](spark, folder))
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in got) == multiset(components([r[:2] for r in odd_rows]))


@pytest.mark.parametrize("tile_rows,block_rows", [(64, 256), (3, 4)])
def test_jaccard_on_families(spark, tile_rows, block_rows):
    """Families around the limit, one large one, and a passage that all share; also with tiny tiles and blocks."""
    import random

    from tidegauge.llm.jaccard import near_duplicates

    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(4000)}"
    line, items = [word() for _ in range(12)], []
    for family in range(14):
        text = [word() for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(40 if family == 0 else 5):
            copy = list(text)
            for _ in range(rng.randrange(1 + len(text) // 25)):
                copy[rng.randrange(len(copy))] = word()
            items.append((len(items), " ".join(copy + (line if family % 3 == 0 else []))))
    df = spark.createDataFrame(items, "doc_id bigint, text string").repartition(4)
    got = rows(near_duplicates(df, tile_rows=tile_rows, block_rows=block_rows))
    want = components(items)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)
    assert 1 < len({c for _, _, c in want}) < len(items)


def common_phrases(rng, docs, length, phrases, each):
    """Texts of seldom words in which ``each`` of some common phrases stand; every tenth text has a near copy."""
    word = lambda: f"w{rng.randrange(1 << 30)}"
    common, items = [" ".join(word() for _ in range(6)) for _ in range(phrases)], []
    for k in range(docs):
        text = [word() for _ in range(length)]
        for phrase in rng.sample(common, each):
            text.insert(rng.randrange(len(text)), phrase)
        items.append((len(items), " ".join(text)))
        if k % 10 == 0:
            items.append((len(items), " ".join(text) + " " + word()))
    return items


def test_jaccard_of_common_phrases(spark, monkeypatch):
    """Texts that share a few phrases with many others, but with none of them enough, are not compared as one group."""
    import random

    from tidegauge.llm import jaccard

    counts, store = {}, jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, purpose, *more: [out := store(df, purpose, *more), counts.update({purpose: out.count()})][0])
    items = common_phrases(random.Random(3), 150, 60, 15, 2)
    df = spark.createDataFrame(items, "doc_id bigint, text string").repartition(4)
    got = rows(jaccard.near_duplicates(df, tile_rows=3, block_rows=4, buckets=16))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components(items))
    assert len({r.component_id for r in got}) == 150
    assert counts["jaccard-tiles"] < 2 * len(items)


@pytest.mark.parametrize("least,most,words,tile_rows,block_rows", [(5, 16, 3, 8, 64), (5, 60, 4, 2, 3), (30, 120, 3, 2, 3)])
def test_jaccard_of_common_words(spark, least, most, words, tile_rows, block_rows):
    """Hardly any shingle is seldom: links by large tiles alone, by small and large ones, across blocks of many sizes."""
    import random

    from tidegauge.llm.jaccard import near_duplicates

    rng, items = random.Random(7), []
    for k in range(70):
        text = [f"w{rng.randrange(words)}" for _ in range(rng.randint(least, most))]
        for _ in range(3):
            items.append((len(items), " ".join(text)))
            text[rng.randrange(len(text))] = f"w{rng.randrange(words)}"
    df = spark.createDataFrame(items, "doc_id bigint, text string").repartition(3)
    want = components(items)
    got = rows(near_duplicates(df, tile_rows=tile_rows, block_rows=block_rows, buckets=64))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)
    assert 1 < len({c for _, _, c in want}) < len(items)


def test_large_groups_have_larger_blocks(spark, monkeypatch):
    """Sets travel once for each block of their group that can hold a link: 16 times, not once per ``block_rows`` classes."""
    from tidegauge.llm import jaccard

    star = spark.range(1, 4000).selectExpr("0L AS a", "id AS b", "true AS star")
    tiles = lambda sizes: jaccard.bundles(star, spark.sql(f"SELECT id AS key, {sizes} AS n FROM range(4000)"), 8, 80)
    alike = tiles("1000L").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert alike <= 17
    apart = tiles("10L + id").count()
    assert apart < 4000 * 9  # 10 to 4,009 shingles: most blocks are too far apart
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 20_000)
    assert tiles("1000L").groupBy("bundle").count().agg({"count": "max"}).first()[0] <= 4 * 20


def removed(items, length=50):
    first = {}
    for key, text in items:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            w = data[p:p + length]
            first[w] = min(first.get(w, key), key)
    out = []
    for key, text in items:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p:p + length]] < key:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(spark, queries, folder, odd_rows):
    items = [(1 << 62 if r[0] is None else r[0], r[1]) for r in odd_rows]
    got = rows(queries["op10_suffix_dedup"](spark, folder))
    want = removed(items)
    assert multiset((r.doc_id if r.doc_id is not None else 1 << 62, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == multiset(want)
    assert sum(w[2] for w in want) > 0


def test_substrings_at_the_edges(spark):
    """Matches of 49, 50 and more bytes, inside periods, over several sources, in non-ASCII text."""
    import random

    from tidegauge.llm.substrings import deduplicated

    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    a, b = letters(300), letters(300)
    texts = [a, b, letters(30) + a[100:149] + letters(30), letters(9) + a[100:150] + letters(30), a[50:120] + b[10:90] + a[60:130], "ab" * 200, "ba" * 60 + letters(20),
             a[:80] + "ab" * 30, b[200:260], "é" * 60, "é" * 30 + "e", a + b]
    items = list(enumerate(texts))
    got = rows(deduplicated(spark.createDataFrame(items, "doc_id bigint, text string").repartition(3)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(removed(items))


def test_decontamination(spark, queries, folder, odd):
    from tidegauge.llm.decontamination import leaks

    item = "If Alice buys 12 apples for 3 dollars each, how many dollars does Alice spend on 12 apples in total over 4 weeks?"
    other = "the quick brown fox jumps over the lazy dog while nobody at all is looking at it"
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "tiny item")], "item_id bigint, text string")
    new = item.replace("Alice", "Bob").replace("12", "40").replace("3 dollars", "7 dollars")
    broken = item.replace("12 apples in", "13 apples in")
    docs = [(1, "before. " + item + " after it"), (2, "words " * 30 + new), (3, broken), (4, other.upper()), (5, "nothing of that kind " * 20), (6, None), (7, ""),
            (8, "a tiny item here"), (9, " ".join(other.split()[:9]))]
    got = {r.doc_id: (r["items"], r.changed) for r in rows(leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench))}
    assert got == {1: ([1], False), 2: ([1], True), 4: ([2], False), 8: ([4], False), 9: ([2], False)}
    assert [(r.doc_id, r.contaminated) for r in rows(queries["op5_decontamination"](spark, folder))] == []


def test_decontamination_with_torn_values(spark):
    from tidegauge.llm import decontamination
    from tidegauge.llm.decontamination import leaks

    long = ("A farmer packs 12 apples into every crate and then loads all of the crates onto a waiting truck before driving slowly "
            "to the market where each customer buys exactly 12 apples from the first crate that is opened by the friendly farmer")
    same = "Tom has 3 apples and 3 pears in his old basket. How many fruits does Tom have in total?"
    two = "Tom has 5 plums and 3 melons in his new cart. How many fruits can Tom sell in total?"
    bench = spark.createDataFrame([(1, long), (2, same), (3, two)], "item_id bigint, text string")
    docs = [(1, "x " + long.replace("exactly 12", "exactly 13")), (2, same.replace("3 apples and 3", "4 apples and 5")),
            (3, two.replace("5 plums and 3", "4 plums and 4")), (4, long), (5, "other words about a farmer " * 9)]
    got = {r.doc_id: (r["items"], r.changed) for r in rows(leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench))}
    assert got == {1: ([1], True), 2: ([2], True), 3: ([3], True), 4: ([1], False)}
    # the largest set: two of three windows agree on a's value, the third is left out
    windows = [(0, [("a", "x")]), (8, [("a", "x"), ("b", "y")]), (16, [("a", "z"), ("c", "y"), ("b", "x")])]
    assert decontamination.agreement(windows, 8, 24, 0.5, 99) == (16, True)
    assert decontamination.agreement(windows, 8, 40, 0.5, 99) is None


def test_decontamination_with_few_ordinary_words(spark):
    from tidegauge.llm.decontamination import leaks

    half = "Please find the sum of all these numbers for me: 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26"
    items = ["Compute 3 x 4 + 5 x 6", "What is 15% of 240?", "hours 7 8 9 and minutes 4 5 6", half]
    docs = [(i, f"We said 9 {text} and went on.") for i, text in enumerate(items)] + [(i + 10, text.upper()) for i, text in enumerate(items)]
    docs += [(20, "Compute 3 x 4 + 5 x 7"), (21, "what is 15% of 250?"), (22, "11 12 13 14 15 16 17"), (23, "hours 7 8 9"), (24, half.replace("me:", "you:").replace(" 1", " 2"))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r.doc_id: (r["items"], r.changed) for r in rows(leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench))}
    assert got == {i + d: ([i], False) for i in range(4) for d in (0, 10)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_finds_all_within_one_edit():
    import random

    from tidegauge.llm.toxicity import Lexicon

    rng = random.Random(3)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))): rng.random() for _ in range(60)}
    lexicon = Lexicon(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(3, 9)))
        near = [t for t in terms if edits(word, t) <= 1]
        assert lexicon.near(word) == (max(near, key=terms.get) if near else None)


def test_toxicity(spark, queries, folder, odd_rows):
    got = rows(queries["op4_toxicity"](spark, folder))
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_toxicity_on_held_out_rows(spark, queries):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in rows(queries["op4_toxicity"](spark, d)) if r.held_out and r.doc_id in labels]
    hit = sum(r.predicted and labels[r.doc_id] for r in held)
    assert hit / sum(labels[r.doc_id] for r in held) > 0.88 and hit / sum(r.predicted for r in held) > 0.88


def test_quotation_counts_apart():
    from tidegauge.llm.toxicity import Scorer

    scorer = Scorer({"moron": 3.0})
    assert scorer.features("you are a moron !")[0] > 0 and scorer.features("you are a m0ron !")[1] > 0
    assert scorer.features('he "moron " ok')[2] > 0 and scorer.features("she said moron")[2] > 0 and scorer.features("") == [0.0] * 4


def test_mixing_spreads_rows_without_keys(spark):
    from tidegauge.llm.mixing import hashed, mixed
    from pyspark.sql import functions as F

    rows = [(None, f"{i:05} a b", "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    h = docs.select(hashed(F.concat_ws("|", F.lit(""), F.md5("text"))).alias("h"))
    assert max(r["count"] for r in h.groupBy(F.col("h") % 8).count().collect()) < 3000 / 4
    out = mixed(docs, part_rows=100)
    assert out.count() == 3000 and out.agg(F.sum("copies")).first()[0] == 3000  # one source: each once


def test_licence_phrases_word_for_word(spark):
    from tidegauge.llm.licenses import scan

    whole = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    texts = [whole, "redistribution X use Y source Z binary forms with or without modification are permitted", whole.replace("and use in", "or use in"),
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "the and in or to of is a this for with",
             "permission is hereby granted free for charge to any person obtaining a copy"]
    got = {r.doc_id: r.labels for r in rows(scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")))}
    assert got == {0: "bsd", 1: "", 2: "", 3: "mit-notice", 4: "", 5: ""}
