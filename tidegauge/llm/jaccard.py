"""N-gram Jaccard join: exact links between documents whose shingle sets overlap by 80 %.

1. One pass takes every text's set of word shingles (64-bit hashes, sorted). Texts with
   equal sets are one class; only classes are compared. The pass also counts shingles in
   a table of hashed buckets of fixed size.
2. Sets are put in one global order, rare buckets first. Two sets that link share m
   shingles among the first n - ceil(0.8 n) + m of each, with m a tenth of the smaller size
   between 1 and 8, or a twentieth if that is more; a second pass emits only those.
   Shingles that very many documents share stand last and are emitted only by documents
   that hold hardly anything else.
3. Classes that share m emitted shingles and lie in one size band are candidates. A tile
   of up to ``tile_rows`` classes gives pairs, a larger one counts as shared by all pairs of
   its classes. Classes in m large tiles also give stars, whose connected components are
   compared as a whole; others can only link through small tiles. Pairs are bundled by
   their smallest neighbour, so that a family meets in one place.
4. A bundle of more than ``block_rows`` classes is cut into size-ordered blocks, and each
   pair of blocks of sizes that can link is a tile of its own. In a tile, hashed bitmaps bound the overlap from
   above by bit counts; pairs that may link and are not connected yet are checked by
   intersecting the sorted arrays. Links within one component need not all be emitted:
   each tile emits a spanning forest of its links.

Sets travel only for classes that have candidates, once per tile.

Defined results: a null text and a text without words have an empty set, n_shingles 0 and
link with nothing; with fewer words than a shingle the whole sequence is the only
shingle; repeated rows share a class; rows that share a doc_id count as one document;
a null doc_id takes part but is never a component's id (null if there is no other);
extra columns are ignored; an empty table gives an empty table. Hashes of 64 bits stand
for shingles and sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.bitmaps import bit_of, id_bitmap, passing
from tidegauge.llm.graphs import components
from tidegauge.session import materialize

WORDS = 5
PERCENT = 80
TILE_ROWS, BLOCK_ROWS = 64, 256
#: A group is cut into more blocks than this only if blocks would hold more shingles than that.
FEW_BLOCKS, BLOCK_MEMBERS = 16, 1 << 20
#: Prefixes are longer by up to so many shingles, or by that part of long sets, and candidates must share as many.
MOST_SHARED, SHARED_PART = 8, 20
#: Hashed buckets that shingles are counted in. More tell moderately frequent shingles of a larger corpus apart.
BUCKETS = 1 << 18

U = np.uint64
_MULTIPLIERS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes. Words are split at ASCII white space, A-Z are lower-cased."""
    import xxhash

    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), "<u8").astype(np.uint64)
    width = min(words, len(hashes))
    n = len(hashes) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = (total ^ (total >> U(27))) * _MULTIPLIERS[i % 5] + hashes[i:i + n]
    return np.unique(_mixed(total))


def set_key(found: np.ndarray) -> int | None:
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))) if len(found) else None


def shared_at_least(n: np.ndarray | int):
    """How many of the emitted shingles two linked sets share, by the size of the smaller one."""
    n = np.asarray(n)
    return np.clip(n // 10, 1, np.maximum(MOST_SHARED, n // SHARED_PART)).astype(np.int64)


def rare_first(found: np.ndarray, ranks: np.ndarray, shift: int, percent: int = PERCENT) -> np.ndarray:
    """The first n - ceil(0.8 n) + m shingles of a set; m of them a linked set emits too. Equal ranks stand in the order of hashes."""
    n = len(found)
    keep = n + (-percent * n // 100) + int(shared_at_least(n))
    return found[np.argsort(ranks[found >> U(shift)], kind="stable")[:keep]]


def _slices(batches: Iterator, rows: int) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def measured(docs: DataFrame, buckets: int, words: int) -> DataFrame:
    """Rows of documents (doc_id, n, key) and, with a bucket, of shingle counts."""
    shift = 64 - buckets.bit_length() + 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = None
        for batch in _slices(batches, 512):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            found = np.bincount((every >> U(shift)).astype(np.int64), minlength=buckets)
            counts = found if counts is None else counts + found
            n = len(sets)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
                "key": pa.array([set_key(s) for s in sets], pa.int64()),
                "bucket": pa.nulls(n, pa.int32()), "count": pa.nulls(n, pa.int64()),
            })
        if counts is not None:
            full = np.flatnonzero(counts)
            for at in range(0, len(full), 100_000):
                part = full[at:at + 100_000]
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": none, "n": none, "key": none, "bucket": pa.array(part, pa.int32()), "count": pa.array(counts[part], pa.int64()),
                })

    return docs.mapInArrow(run, "doc_id bigint, n bigint, key bigint, bucket int, count bigint")


def bucket_ranks(stored: DataFrame, buckets: int) -> np.ndarray:
    """Two bytes per bucket: the place of its count among all counts. As many rows as there are buckets come to the driver.

    Counts are told apart to the last one: in a large corpus a bucket counts thousands of seldom shingles, about as
    many as its neighbours, and a shingle of a hundred documents shows as a hundred more.
    """
    rows = stored.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("count")).toPandas()
    counts = np.zeros(buckets, np.int64)
    counts[rows["bucket"].to_numpy()] = rows["count"].to_numpy()
    found, place = np.unique(counts, return_inverse=True)
    most = np.iinfo(np.uint16).max
    return (place if len(found) <= most else place * most // (len(found) - 1)).astype(np.uint16)


def prefix_rows(docs: DataFrame, ranks: np.ndarray, words: int, percent: int) -> DataFrame:
    """(shingle, n, key) of the shingles of every set that candidates must share."""
    shift = 64 - len(ranks).bit_length() + 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in _slices(batches, 512):
            heads, sizes, keys = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, words)
                key = set_key(found)
                if key is None or key in seen:
                    continue
                if len(seen) < 200_000:  # copies that meet in a task go once, others are merged in the tiles
                    seen.add(key)
                heads.append(rare_first(found, ranks, shift, percent))
                sizes.append(len(found))
                keys.append(key)
            if heads:
                lengths = [len(h) for h in heads]
                yield pa.RecordBatch.from_pydict({
                    "shingle": pa.array(np.concatenate(heads).view(np.int64)), "n": pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                    "key": pa.array(np.repeat(np.array(keys, np.int64), lengths)),
                })

    return docs.mapInArrow(run, "shingle bigint, n int, key bigint")


def tile_meetings(rows: DataFrame, tile_rows: int, percent: int) -> DataFrame:
    """(a, b, hot, least, tiles): pairs of classes with the number of small tiles they share, and classes b in the large tile of shingle a.

    Rows arrive sorted by shingle and size; a tile that outgrows ``tile_rows`` is passed
    on as it comes, so no tile is ever held whole.
    """
    def pairs(key: np.ndarray, n: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        found = []
        for length in np.unique(lengths[lengths > 1]):
            at = starts[lengths == length][:, None] + np.arange(length)
            i, j = np.triu_indices(int(length), 1)
            left, right = at[:, i].ravel(), at[:, j].ravel()
            band = 100 * n[left].astype(np.int64) >= percent * n[right].astype(np.int64)
            found.append(np.stack((key[left[band]], key[right[band]], shared_at_least(n[left[band]]))))
        return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def record(a, b, hot: bool, least, tiles):
            return pa.RecordBatch.from_pydict({
                "a": pa.array(a), "b": pa.array(b), "hot": pa.array(np.full(len(a), hot)), "least": pa.array(least), "tiles": pa.array(tiles),
            })

        def met(a: np.ndarray, b: np.ndarray, least: np.ndarray):
            ends = np.stack((np.minimum(a, b), np.maximum(a, b), least))[:, a != b]
            ends, count = np.unique(ends, axis=1, return_counts=True) if ends.shape[1] else (ends, np.zeros(0, np.int64))
            return record(ends[0], ends[1], False, ends[2], count.astype(np.int64))

        def crowd(shingle: int, n: np.ndarray, key: np.ndarray):
            """A linked set has at least ``percent`` of the size."""
            return record(np.full(len(key), shingle), key, True, shared_at_least(-(-percent * n.astype(np.int64) // 100)), np.ones(len(key), np.int64))

        held = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        hot: int | None = None  # shingle of the large tile under way

        def settled(shingle, n, key, last: bool):
            nonlocal hot, held
            new = np.ones(len(shingle), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1])  # copies from other tasks
            shingle, n, key = shingle[new], n[new], key[new]
            if hot is not None and len(shingle):
                more = int(np.searchsorted(shingle, hot, "right"))
                if more:
                    yield crowd(hot, n[:more], key[:more])
                    shingle, n, key = shingle[more:], n[more:], key[more:]
                if len(shingle):
                    hot = None
            starts = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1]))) if len(shingle) else np.zeros(0, np.int64)
            lengths = np.diff(np.append(starts, len(shingle)))
            if len(starts) and not last:  # the last tile may go on
                if lengths[-1] > tile_rows:
                    hot = int(shingle[-1])
                    held = (shingle[:0], n[:0], key[:0])
                    yield crowd(hot, n[starts[-1]:], key[starts[-1]:])
                else:
                    held = (shingle[starts[-1]:], n[starts[-1]:], key[starts[-1]:])
                starts, lengths = starts[:-1], lengths[:-1]
            else:
                held = (shingle[:0], n[:0], key[:0])
            for s, size in zip(starts[lengths > tile_rows].tolist(), lengths[lengths > tile_rows].tolist()):
                yield crowd(int(shingle[s]), n[s:s + size], key[s:s + size])
            small = lengths <= tile_rows
            yield met(*pairs(key, n, starts[small], lengths[small]))

        for batch in batches:
            shingle, n, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "n", "key"))
            yield from settled(*(np.concatenate(p) for p in zip(held, (shingle, n, key))), False)
        yield from settled(*held, True)

    dealt = rows.repartition("shingle").sortWithinPartitions("shingle", "n", "key")
    found = dealt.mapInArrow(run, "a bigint, b bigint, hot boolean, least bigint, tiles bigint")
    return found.groupBy("a", "b", "hot").agg(F.max("least").alias("least"), F.sum("tiles").alias("tiles"))


def tile_edges(met: DataFrame) -> DataFrame:
    """(a, b, star): candidate pairs of small tiles and stars of large ones.

    Two classes share at most as many large tiles as either is in; what they then lack, small
    tiles must give. Those that share large tiles alone are in ``least`` of them, and share one
    of the first but ``least`` - 1 of each in any order; others stay out of the stars.
    """
    crowds = met.where("hot").select(F.col("a").alias("shingle"), F.col("b").alias("key"), "least")
    within = Window.partitionBy("key")
    ranked = crowds.withColumn("large", F.count("*").over(within)).withColumn("place", F.row_number().over(within.orderBy("shingle")))
    ranked = materialize(ranked, "jaccard-crowds")
    large = materialize(ranked.where("place = 1").select("key", "large"), "jaccard-large")
    of = lambda end: large.select(F.col("key").alias(end), F.col("large").alias(f"large_{end}"))
    both = met.where("NOT hot").join(of("a"), "a", "left").join(of("b"), "b", "left")
    most = F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0)))
    pairs = both.where(F.col("tiles") + most >= F.col("least")).select("a", "b", F.lit(False).alias("star"))
    first = ranked.where("place <= large - least + 1").select("shingle", "key")
    centres = first.groupBy("shingle").agg(F.min("key").alias("centre"))
    stars = first.join(centres, "shingle").where("key > centre").select(F.col("centre").alias("a"), F.col("key").alias("b"), F.lit(True).alias("star"))
    return pairs.union(stars.distinct())


def bundles(edges: DataFrame, sizes: DataFrame, block_rows: int, percent: int) -> DataFrame:
    """(bundle, side, key): side 0 and 1 are compared with each other, side -1 within itself."""
    stars = materialize(components(edges.where("star")), "hot-groups")
    pairs = edges.where("NOT star").select("a", "b")
    nearest = (
        pairs.union(pairs.select("b", "a")).groupBy("a").agg(F.min("b").alias("least"))
        .select("a", F.least("a", "least").alias("family"))
    )
    families = pairs.join(nearest, "a").select("family", F.explode(F.array("a", "b")).alias("key")).distinct()
    members = families.select(F.struct(F.lit("pairs").alias("kind"), "family").alias("grp"), "key").union(
        stars.select(F.struct(F.lit("star").alias("kind"), F.col("root").alias("family")).alias("grp"), F.col("node").alias("key"))
    ).join(sizes, "key")
    # size-ordered blocks by counts per size: no group is sorted in one task
    by_size = members.groupBy("grp", "n").agg(F.count("*").alias("rows"))
    upto = Window.partitionBy("grp").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp")
    # sets travel once per block: a large group has larger ones, as far as their members fit a task
    most = F.least(F.floor(F.sum("rows").over(whole) / FEW_BLOCKS), F.floor(F.lit(BLOCK_MEMBERS) / F.max("n").over(whole)))
    placed = by_size.withColumn("before", F.coalesce(F.sum("rows").over(upto), F.lit(0))).withColumn("fill", F.greatest(F.lit(block_rows), most))
    placed = placed.withColumn("blocks", F.ceil(F.sum("rows").over(whole) / F.col("fill")))
    # documents of one size spread over as many blocks as they fill
    spread = F.floor((F.col("before") + F.pmod(F.xxhash64("key"), F.col("rows"))) / F.col("fill"))
    blocked = members.join(placed, ["grp", "n"]).withColumn("block", spread).select(F.xxhash64("grp").alias("grp"), "blocks", "block", "n", "key")
    blocked = materialize(blocked, "jaccard-blocks")
    many = blocked.where("blocks > 1")
    sized = many.groupBy("grp", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    others = sized.select("grp", *[F.col(c).alias(f"other_{c}") for c in ("block", "low", "high")])
    # blocks of sizes too far apart hold no links
    near = sized.join(others, "grp").where((100 * F.col("high") >= percent * F.col("other_low")) & (100 * F.col("other_high") >= percent * F.col("low")))
    met = blocked.where("blocks = 1").withColumn("other_block", F.col("block")).select("grp", "block", "other_block", "key").union(
        many.join(near.select("grp", "block", "other_block"), ["grp", "block"]).select("grp", "block", "other_block", "key"))
    return met.select(
        F.xxhash64("grp", F.least("block", "other_block"), F.greatest("block", "other_block")).alias("bundle"),
        F.when(F.col("block") == F.col("other_block"), -1).when(F.col("block") < F.col("other_block"), 0).otherwise(1).alias("side"), "key",
    )


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bits per set, four times as many as the largest set has members, 65,536 at most."""
    bits = min(1 << 16, max(256, 1 << (4 * max(map(len, sets)) - 1).bit_length()))
    rows = np.zeros((len(sets), bits // 64), np.uint64)
    for row, found in zip(rows, sets):
        at = found & U(bits - 1)
        np.bitwise_or.at(row, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return rows


def linked(sets: list[np.ndarray], sides: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links of one tile, as positions."""
    if len(sets) < 2:
        return []
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    side = np.array([sides[k] for k in order])
    bits = bitmaps([sets[k] for k in order])
    forest, found = Forest(len(order)), []
    for i in range(len(order) - 1):
        end = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
        rest = np.arange(i + 1, end)
        rest = rest[(side[rest] == -1) | (side[rest] != side[i])]
        if not len(rest):
            continue
        only_a = np.bitwise_count(bits[i] & ~bits[rest]).sum(axis=1, dtype=np.int64)
        only_b = np.bitwise_count(bits[rest] & ~bits[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(sizes[i] - only_a, sizes[rest] - only_b)  # each lone bit is a member the other lacks
        may = 100 * most >= percent * (sizes[i] + sizes[rest] - most)
        rest, most = rest[may], most[may]
        a = sets[order[i]]
        for j in rest[np.argsort(-most, kind="stable")].tolist():
            if forest.root(i) == forest.root(j):
                continue
            b = sets[order[j]]
            at = np.searchsorted(b, a)
            both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
            if 100 * both >= percent * (len(a) + len(b) - both):
                forest.join(i, j)
                found.append((order[i], order[j]))
    return found


def needed_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, members) of the wanted classes, and of some others.

    A bitmap of fixed size says which documents may be wanted; the join with the tiles is exact.
    """
    mask = id_bitmap(wanted.select(bit_of(F.col("doc_id")).alias("bit")))
    keyed = docs.withColumn("bit", bit_of(F.col("doc_id")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _slices(batches, 512):
            at = passing(mask, batch.column("bit").to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            part = batch.take(pa.array(at))
            sets = [shingles(t, words) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([set_key(s) for s in sets], pa.int64()),
                "members": pa.array([s.tobytes() for s in sets], pa.binary()),
            })

    return keyed.select("bit", "text").mapInArrow(run, "key bigint, members binary")


def tile_links(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links found in the tiles; a task holds one tile at a time."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, keys, sides, sets, out = None, [], [], [], []

        def close():
            out.extend((keys[i], keys[j]) for i, j in linked(sets, sides, percent))
            keys.clear(), sides.clear(), sets.clear()

        for batch in batches:
            for bundle, side, key, members in zip(*(batch.column(c).to_pylist() for c in ("bundle", "side", "key", "members"))):
                if bundle != now:
                    close()
                    now = bundle
                if not keys or keys[-1] != key:  # copies of a class
                    keys.append(key)
                    sides.append(side)
                    sets.append(np.frombuffer(members, np.uint64))
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
                out = []
        close()
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    full = tiles.join(sets, "key").repartition("bundle").sortWithinPartitions("bundle", "key")
    return full.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT,
    tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ROWS, buckets: int = BUCKETS,
) -> DataFrame:
    """key, n_shingles, component_id and ``class_copies`` (documents with an equal set, itself included)."""
    source = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    stored = materialize(measured(source, buckets, words), "jaccard-sets")
    rows = stored.where("bucket IS NULL").select("doc_id", "n", "key")
    classes = materialize(
        rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.count("*").alias("class_copies")),
        "jaccard-classes",
    )
    ranks = bucket_ranks(stored, buckets)
    met = materialize(tile_meetings(prefix_rows(source, ranks, words, percent), tile_rows, percent), "jaccard-met")
    edges = materialize(tile_edges(met), "jaccard-edges")
    tiles = materialize(bundles(edges, classes.select("key", "n"), block_rows, percent), "jaccard-tiles")
    wanted = tiles.select("key").distinct().join(classes, "key").select(F.col("first").alias("doc_id"), "key")
    links = materialize(tile_links(tiles, needed_sets(source, materialize(wanted, "jaccard-wanted"), words), percent), "jaccard-links")
    # rows that share a doc_id are one document
    keyed = rows.where("key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "key")
    split = keyed.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a < z").select("doc_id", "a")
    joined = links.union(keyed.join(split, "doc_id").select("a", F.col("key").alias("b")))
    roots = components(joined)
    placed = classes.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = placed.join(smallest, "root").select("key", "component_id", "class_copies")
    return rows.join(of_class, "key", "left").select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("class_copies", F.lit(1)).alias("class_copies"),
    )
