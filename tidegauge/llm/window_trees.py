"""Substring dedup over words: prefix-partitioned suffix trees and what their deep nodes share.

1. One scan of the texts. Of the 16-word grams inside each window of 50 words the one of
   smallest hash is an anchor: equal windows have equal anchors at equal places, so trees
   over the suffixes that start at anchors see every repeat. A text whose words are those of
   a smaller id is covered whole; only one of equal texts goes on.
2. Anchors that two documents have are found by an aggregate and a join. Their suffixes
   (50 words, and the words before them that a window can reach) are written once; equal
   ones are one leaf with its smallest id, whatever the number of documents.
3. Leaves are dealt out by prefixes of variable length: the 16 words of their anchor where
   the leaves of one anchor fit in memory, and the whole 50 words of every window where they
   do not, so that a hot anchor is spread over all tasks.
4. A task sorts the suffixes of a bundle of prefixes; the lengths that neighbours share are
   the subtree's internal nodes. Under a node r words deep, leaves whose 50 - r words to
   the left agree share a window; the smallest id below it covers the others.
5. Covered words meet their texts, which are cut and digested.

Words are the maximal runs of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return. They are compared as 64-bit hashes, whole texts and suffixes as
128-bit and 256-bit ones.

Defined results: a null text has no words; a null id is larger than every other and is
never a source; rows of one id are no sources for each other; equal rows give equal
results; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.word_windows import anchors, joined, word_codes
from tidegauge.session import materialize

WINDOW, GRAM = 50, 16
#: Leaves of one anchor beyond which longer prefixes are used; leaves that a task sorts at once.
HOT, BUNDLE = 20_000, 20_000
LAST = (1 << 63) - 1
#: Bits of the filters that keep texts without any repeat out of exchanges; exact joins follow.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25

U = np.uint64


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    source = docs.select(docs[key].cast("bigint").alias("doc_id"), body.alias("text")).withColumn("row", F.xxhash64("doc_id", F.md5("text")))
    return source.withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))


def only(frame: DataFrame, keys: DataFrame, column: str, rows: int) -> DataFrame:
    """``frame`` without most rows whose ``column`` is not among the keys; never without one that is.

    The keys become a bitmap of 8 bits for each of ``rows``, within bounds, that is joined
    as a broadcast table: 4 MB at most, beyond which it lets more rows pass.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * rows).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    words = keys.select(place.alias("bit")).groupBy(F.floor(F.col("bit") / 62).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 62).cast("int"))).alias("mask"))
    met = frame.join(F.broadcast(words), F.floor(place / 62) == F.col("word"))
    set_ = F.call_function("shiftright", F.col("mask"), (place % 62).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return met.where(set_ == 1).drop("word", "mask")


def scanned(source: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """row, doc_id, n_words, digest (SHA-256 of the words joined by blanks), and the anchors of each text."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, digests, grams, places = [], [], [], []
                for body in part.column("text"):
                    words = body.as_py().encode().split()
                    where, found = anchors(word_codes(words), window, gram) if len(words) >= window else ((), ())
                    sizes.append(len(words))
                    digests.append(hashlib.sha256(b" ".join(words)).digest())
                    grams.append(np.asarray(found, U).view(np.int64))
                    places.append(np.asarray(where, np.int32))
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(g) for g in grams]))).astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "row": part.column("row"), "doc_id": part.column("doc_id"), "n_words": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary()),
                    "grams": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(grams))),
                    "places": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places))),
                })

    schema = "row bigint, doc_id bigint, n_words bigint, digest binary, grams array<bigint>, places array<int>"
    return source.select("row", "doc_id", "text").mapInArrow(run, schema)


def suffixes(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """gram, leaf (hash of the words), doc, row, pos, and the words before and from each wanted anchor on."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                for row, doc, body, wanted in zip(*(part.column(c) for c in ("row", "doc", "text", "wanted"))):
                    row = row.as_py()
                    if row == last:  # repeated rows follow each other
                        continue
                    last, doc, words = row, doc.as_py(), body.as_py().encode().split()
                    for one in wanted.as_py():
                        pos = one["pos"]
                        left, right = b" ".join(words[max(0, pos - window + gram):pos]), b" ".join(words[pos:pos + window])
                        leaf = hashlib.blake2b(left + b"\n" + right, digest_size=16).digest()
                        rows.append((one["gram"], leaf, doc, row, pos, left, right))
                if rows:
                    g, leaf, doc, row, pos, left, right = zip(*rows)
                    yield pa.RecordBatch.from_pydict({
                        "gram": pa.array(g, pa.int64()), "leaf": pa.array(leaf, pa.binary()), "doc": pa.array(doc, pa.int64()),
                        "row": pa.array(row, pa.int64()), "pos": pa.array(pos, pa.int32()),
                        "before": pa.array(left, pa.binary()).cast(pa.string()), "suffix": pa.array(right, pa.binary()).cast(pa.string()),
                    })

    return texts.mapInArrow(run, "gram bigint, leaf binary, doc bigint, row bigint, pos int, before string, suffix string")


def _matrix(texts: list[str], width: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of each text, one row each (0: no word), and the numbers of words."""
    words = [t.encode().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    codes = word_codes([x for w in words for x in (reversed(w) if backwards else w)])
    out = np.zeros((len(texts), width), U)
    out[np.arange(width) < sizes[:, None]] = codes
    return out, sizes


class Subtree:
    """The suffix tree of some suffixes: their order, and the words that each shares with the one before."""

    def __init__(self, suffixes: np.ndarray):
        self.order = np.lexsort(suffixes.T[::-1]) if len(suffixes) else np.empty(0, np.int64)
        ordered = suffixes[self.order]
        differ = ordered[1:] != ordered[:-1]
        self.shared = np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1])

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix in order the number of the node ``depth`` words deep that it hangs under."""
        return np.concatenate(([0], np.cumsum(self.shared < depth)))


def sources(before: list[str], suffix: list[str], docs: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Row k, column d: the smallest id with the window that starts d words before suffix k (-1: no such window)."""
    right, n_right = _matrix(suffix, window)
    left, n_left = _matrix(before, window - gram, backwards=True)
    tree = Subtree(right)
    left, n_left, n_right, docs = left[tree.order], n_left[tree.order], n_right[tree.order], docs[tree.order]
    out = np.full((len(docs), window - gram + 1), -1, np.int64)
    reach = np.zeros(len(docs), U)
    for d in range(window - gram + 1):
        if d:
            reach = joined(reach, left[:, d - 1])
        has = np.flatnonzero((n_left >= d) & (n_right >= window - d))
        if not len(has):
            continue
        node = tree.nodes(window - d)[has]
        by = np.lexsort((reach[has], node))
        new = np.ones(len(by), bool)
        new[1:] = (node[by][1:] != node[by][:-1]) | (reach[has][by][1:] != reach[has][by][:-1])
        heads = np.flatnonzero(new)
        least = np.minimum.reduceat(docs[has][by], heads)
        out[has[by], d] = np.repeat(least, np.diff(np.append(heads, len(by))))
    back = np.empty_like(out)
    back[tree.order] = out
    return back


def _stretches(found: np.ndarray, highest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, from, to, doc): neighbouring windows of one leaf with one source, where some document of the leaf is later than it."""
    useful = (found >= 0) & (found < highest[:, None])
    value = np.where(useful, found, -1)
    edge = np.ones_like(useful)
    edge[:, 1:] = value[:, 1:] != value[:, :-1]
    leaf, first = np.nonzero(edge)
    after = np.append(first[1:], 0)
    ends = np.where(np.append(leaf[1:], -1) == leaf, after, found.shape[1]) - 1
    doc = value[leaf, first]
    keep = doc >= 0
    return leaf[keep], first[keep], ends[keep], doc[keep]


def trees(leaves: DataFrame, window: int = WINDOW, gram: int = GRAM, bundle: int = BUNDLE) -> DataFrame:
    """(leaf, found) from subtrees: windows that start ``near`` to ``far`` words before the suffix occur in ``source``."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def record(held: list):
            table = pa.Table.from_batches(held)
            found = sources(table["before"].to_pylist(), table["suffix"].to_pylist(), table["low"].to_numpy(), window, gram)
            leaf, near, far, doc = _stretches(found, table["high"].to_numpy())
            some, first = np.unique(leaf, return_index=True)
            parts = pa.StructArray.from_arrays([pa.array(near, pa.int32()), pa.array(far, pa.int32()), pa.array(doc, pa.int64())], ["near", "far", "source"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(leaf)).astype(np.int32)), parts)
            return pa.RecordBatch.from_pydict({"leaf": table["leaf"].combine_chunks().take(pa.array(some)), "found": lists})

        held, count = [], 0
        for batch in batches:  # sorted by anchor; a bundle ends between two anchors
            grams = batch.column("gram").to_numpy()
            cuts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else ()
            if held and len(grams) and held[-1].column("gram")[-1].as_py() == grams[0]:
                cuts = cuts[1:]
            at = 0
            for cut in cuts:
                if count + cut - at >= bundle:
                    if cut > at:
                        held.append(batch.slice(at, cut - at))
                    yield record(held)
                    held, count, at = [], 0, int(cut)
            if at < batch.num_rows:
                held.append(batch.slice(at))
                count += batch.num_rows - at
        if held:
            yield record(held)

    dealt = leaves.select("gram", "leaf", "low", "high", "before", "suffix").repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "leaf binary, found array<struct<near: int, far: int, source: bigint>>")


def spread(leaves: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """As ``trees``, for leaves of hot anchors: every window is a prefix of its own, counted by an aggregate."""
    parts = leaves.select("leaf", "low", "high", F.array_remove(F.split("before", " "), "").alias("l"), F.split("suffix", " ").alias("r"))
    windows = parts.select("leaf", "low", "high", "l", "r", F.explode(F.sequence(F.lit(0), F.lit(window - gram))).alias("d"))
    windows = windows.where(F.expr(f"size(l) >= d AND size(r) >= {window} - d"))
    whole = F.concat(F.expr("slice(l, size(l) - d + 1, d)"), F.expr(f"slice(r, 1, {window} - d)"))
    named = materialize(windows.select("leaf", "low", "high", "d", F.unhex(F.md5(F.concat_ws(" ", whole))).alias("name")), "hot-windows")
    least = named.groupBy("name").agg(F.min("low").alias("source"))
    met = named.join(least, "name").where("source < high")
    return met.groupBy("leaf").agg(F.collect_list(F.struct(F.col("d").alias("near"), F.col("d").alias("far"), "source")).alias("found"))


def repeated_spans(
    docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, hot: int = HOT,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts with a ``row`` key, what the scan found, and (row, spans): words of each text covered by repeats; ``spans`` is null where all are."""
    source = _texts(docs, text, key)
    scan = materialize(scanned(source, window, gram), "repeat-scan")
    n = scan.count()
    whole = scan.where(F.col("n_words") >= window).withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    firsts = whole.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("other")).where("first < other").select("digest", "first")
    copies = materialize(whole.select("row", "doc", "digest").join(firsts, "digest").where("doc > first").select("row").distinct(), "repeat-copies")
    alive = whole.join(copies, "row", "left_anti").dropDuplicates(["row"])
    met = materialize(alive.select("row", "doc", F.explode(F.arrays_zip("grams", "places")).alias("at"))
                      .select("row", "doc", F.col("at.grams").alias("gram"), F.col("at.places").alias("pos")), "repeat-anchors")
    # stored apart, so that a task that meets a common anchor can be split
    shared = materialize(met.groupBy("gram").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("gram"), "repeat-shared")
    wanted = met.join(shared, "gram", "left_semi").groupBy("row").agg(F.collect_list(F.struct("gram", "pos")).alias("wanted"))
    wanted = materialize(wanted, "repeat-places")
    texts = only(source.select("row", "doc", "text"), wanted, "row", n).join(wanted, "row")
    leaves = materialize(suffixes(texts, window, gram), "repeat-suffixes")
    one = materialize(leaves.groupBy("gram", "leaf", "before", "suffix").agg(F.min("doc").alias("low"), F.max("doc").alias("high")), "repeat-leaves")
    many = materialize(one.groupBy("gram").count().where(F.col("count") > hot).select("gram"), "repeat-hot")
    found = trees(one.join(many, "gram", "left_anti"), window, gram).unionByName(spread(one.join(many, "gram", "left_semi"), window, gram))
    met = leaves.select("leaf", "doc", "row", "pos").join(materialize(found, "repeat-nodes"), "leaf")
    met = met.select("row", "pos", F.filter("found", lambda x: x["source"] < F.col("doc")).alias("found")).where(F.size("found") > 0)
    # all windows of one suffix hold its first word, so together they are one stretch
    start, end = F.array_max(F.col("found.far")), F.array_min(F.col("found.near"))
    cut = met.select("row", (F.col("pos") - start).alias("start"), (F.col("pos") - end + window).alias("end"))
    spans = cut.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    every = spans.unionByName(copies.select("row", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans")))
    return source, scan, materialize(every, "repeat-spans")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_text: bool = False, **options) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and, if asked for, ``kept`` (the remaining words joined by blanks)."""
    source, scan, spans = repeated_spans(docs, text, key, **options)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for body, cut in zip(part.column("text"), part.column("spans")):
                    words = body.as_py().encode().split()
                    change = np.zeros(len(words) + 1, np.int64)
                    for span in cut.as_py() or ():
                        change[span["start"]] += 1
                        change[span["end"]] -= 1
                    stay = np.flatnonzero(np.cumsum(change)[:-1] == 0)
                    left = b" ".join([words[k] for k in stay.tolist()])
                    rows.append((len(stay), hashlib.sha256(left).hexdigest(), left))
                n, digest, left = zip(*rows)
                columns = {"row": part.column("row"), "n_left": pa.array(n, pa.int64()), "kept_sha256": pa.array(digest)}
                yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(left, pa.binary()).cast(pa.string())} if keep_text else {}))

    body = F.when(F.col("copy"), "").otherwise(F.col("text")).alias("text")
    marked = spans.withColumn("copy", F.col("spans").isNull())
    if keep_text:
        texts = source.select("row", "text").join(marked, "row", "left")
        cuts = texts.select("row", body, "spans").mapInArrow(run, "row bigint, n_left bigint, kept_sha256 string, kept string")
    else:  # texts without a repeat are known by the digest of the scan, copies lose all
        partly = spans.where("spans IS NOT NULL")
        texts = only(source.select("row", "text"), partly, "row", scan.count()).join(partly, "row")
        cuts = texts.select("row", "text", "spans").mapInArrow(run, "row bigint, n_left bigint, kept_sha256 string")
        gone = spans.where("spans IS NULL").select("row", F.lit(0).cast("bigint").alias("n_left"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
        cuts = cuts.unionByName(gone)
    cuts = materialize(cuts.withColumnRenamed("kept_sha256", "left_sha256").dropDuplicates(["row"]), "repeat-cuts")
    rows = scan.select("doc_id", "row", "n_words", "digest").join(cuts, "row", "left")
    rows = rows.withColumn("n_removed", F.col("n_words") - F.coalesce("n_left", "n_words"))
    rows = rows.withColumn("kept_sha256", F.coalesce("left_sha256", F.lower(F.hex("digest"))))
    return rows.select(F.col("doc_id").alias(key), "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text)
