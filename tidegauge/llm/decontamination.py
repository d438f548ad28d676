"""Benchmark decontamination by template windows.

Tokens are canonicalised: numbers, units behind numbers, and names (capitalised words
inside a sentence that is not all capitals) become typed placeholders, other words lose case and outer
punctuation. Every window of ``window`` tokens with at least ``least_fixed`` ordinary
words is hashed. Windows with fewer are hashed by their words and values instead, so
stretches full of numbers are found as they are, but not with other numbers. Windows of
documents are joined with those of benchmark items by hash.
Per document, item and alignment, windows that agree must cover ``least_cover`` of the
item (or ``enough`` tokens). Windows with equal values always agree. Windows with other
values agree as far as the values are a function of the item's, or the item's a function
of theirs (two values may happen to coincide on one side); the largest set that does is
taken. A question with other numbers or names is caught, a chance likeness of templates is
not. An item's value that stays in one window and changes in another speaks against an
alignment: such changed windows are left out, and the tokens that only they cover are
taken off the cover unless it reaches ``enough``.

A bitmap of fixed size over the benchmark's hashes keeps windows that cannot match out of
the join. A larger benchmark fills it and lets more windows through; the join decides.

Defined results: null and empty texts have no window; a benchmark item shorter than a
window is one window of its own length, and documents are cut into windows of that length
too; repeated items are reported each; rows that share a doc_id are judged together; extra
columns are ignored; with an empty benchmark nothing is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.pieces import Chunks
from tidegauge.session import materialize

WINDOW, LEAST_FIXED, LEAST_COVER, ENOUGH = 8, 5, 0.5, 24
MASK_BITS = 1 << 20
REMEMBERED = 300_000
#: Steps of the search for the largest set of windows with consistent values.
TRIES = 2000
# Units that count as such behind a number.
UNITS = set(
    "kg g mg km m cm mm mi ft lb lbs oz l ml s sec min h hr hrs usd eur percent mph kmh dollars euros cents miles meters metres "
    "kilometers kilometres grams kilograms litres liters seconds minutes hours days weeks months years inches feet pounds".split()
)
OUTER = ".,;:!?()[]{}\"'`*&#%$|<>~…«»“”‘’"
NUMBER = re.compile(r"[+-]?[€£¥]?\d[\d.,/:]*")
NAME, NUM, UNIT, CAPITAL, STOP, FIXED = 1, 2, 4, 8, 16, 32

U = np.uint64
RECORD = np.dtype([("hash", "<u8"), ("flags", "u1")])
PLACE = {kind: U(0xA5A5_0000_0000_0001 * (k + 3) % (1 << 64)) for k, kind in enumerate((NAME, NUM, UNIT))}
RAW = 1 << 32  # seeds of windows without placeholders
_MULTIPLIER, _FINAL = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)


def _token(raw: str) -> bytes:
    import xxhash

    word = raw.strip(OUTER)
    flags = STOP if raw[-1] in ".!?:" else 0
    if NUMBER.fullmatch(word):
        flags |= NUM
    else:
        flags |= (CAPITAL if word[:1].isupper() and not word.isupper() else 0) | (UNIT if word.lower() in UNITS else 0)
    return xxhash.xxh3_64_intdigest(word.lower().encode()).to_bytes(8, "little") + bytes([flags])


def _hashed(columns, n: int, seed: int) -> np.ndarray:
    total = np.full(n, seed, U)
    for column in columns:
        total = (total ^ (total >> U(29))) * _MULTIPLIER + column
    total = (total ^ (total >> U(31))) * _FINAL
    return total ^ (total >> U(32))


class Templates:
    """Canonical tokens and windows of one text at a time."""

    def __init__(self, remembered: int = REMEMBERED):
        self.known = Chunks(_token, remembered)

    def tokens(self, text: str) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Raw words; canonical hashes with the kind of placeholder (0: an ordinary word); what ``raw_windows`` takes.

        Names cannot be told in a text without case, so a text with names has a second
        form, in which they are ordinary words.
        """
        raw = text.split()
        found = np.frombuffer(b"".join(map(self.known.__getitem__, raw)), RECORD)
        hashes, flags = found["hash"].astype(U), found["flags"]
        before = np.concatenate(([STOP], flags[:-1])) if len(flags) else flags
        kind = np.zeros(len(raw), np.uint8)
        kind[(flags & CAPITAL > 0) & (before & STOP == 0)] = NAME
        kind[(flags & UNIT > 0) & (before & NUM > 0)] = UNIT
        kind[flags & NUM > 0] = NUM
        plain = np.where(kind == NAME, 0, kind).astype(np.uint8)
        forms = [kind, plain] if (plain != kind).any() else [kind]
        out = []
        for form in forms:
            own = hashes.copy()
            for k, value in PLACE.items():
                own[form == k] = value
            out.append((own, form))
        return raw, out, (hashes, plain, flags & (NUM | UNIT) == 0)

    @staticmethod
    def windows(hashes: np.ndarray, kind: np.ndarray, width: int, least_fixed: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows with enough ordinary words."""
        n = len(hashes) - width + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, U)
        total = _hashed((hashes[i:i + n] for i in range(width)), n, width)
        fixed = np.concatenate(([0], np.cumsum(kind == 0)))
        at = np.flatnonzero(fixed[width:] - fixed[:n] >= min(least_fixed, width))
        return at, total[at]

    @staticmethod
    def raw_windows(hashes: np.ndarray, plain: np.ndarray, sure: np.ndarray, width: int, least_fixed: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes, without placeholders, of the windows that may have too few ordinary words.

        A number or unit in front does not count as a word whatever stands before it: equal
        windows are then chosen alike in every text.
        """
        n = len(hashes) - width + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, U)
        fixed = np.concatenate(([0], np.cumsum(plain == 0)))
        at = np.flatnonzero(fixed[width:] - fixed[1:n + 1] + sure[:n] < min(least_fixed, width))
        return at, _hashed((hashes[at + i] for i in range(width)), len(at), width | RAW)


def slots(raw: list[str], kind: np.ndarray, at: int, width: int) -> list[str]:
    return [raw[at + i].strip(OUTER).lower() for i in np.flatnonzero(kind[at:at + width])]


def item_windows(benchmark: DataFrame, text: str, key: str, width: int, least_fixed: int) -> DataFrame:
    """(hash, item, at, width, n_tokens, item_slots)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        make = Templates()
        for batch in batches:
            rows = []
            for item, body in zip(batch.column("item").to_pylist(), batch.column("body").to_pylist()):
                raw, forms, plain = make.tokens(body)
                own = min(width, len(raw))
                if own:
                    for at, h in zip(*make.raw_windows(*plain, own, least_fixed)):
                        rows.append((int(h.view(np.int64)), item, int(at), own, len(raw), []))
                for hashes, kind in forms if own else ():
                    for at, h in zip(*make.windows(hashes, kind, own, least_fixed)):
                        rows.append((int(h.view(np.int64)), item, int(at), own, len(raw), slots(raw, kind, int(at), own)))
            if rows:
                h, item, at, own, n, values = zip(*rows)
                yield pa.RecordBatch.from_pydict({
                    "hash": pa.array(h, pa.int64()), "item": pa.array(item, pa.int64()), "at": pa.array(at, pa.int32()),
                    "width": pa.array(own, pa.int32()), "n_tokens": pa.array(n, pa.int32()), "item_slots": pa.array(values, pa.list_(pa.string())),
                })

    source = benchmark.select(benchmark[key].cast("bigint").alias("item"), F.coalesce(benchmark[text], F.lit("")).alias("body"))
    return source.mapInArrow(run, "hash bigint, item bigint, at int, width int, n_tokens int, item_slots array<string>")


def document_windows(docs: DataFrame, text: str, key: str, mask: np.ndarray, widths: list[int], least_fixed: int) -> DataFrame:
    """(doc_id, hash, pos, doc_slots) of the windows that the bitmap lets through."""
    bits = U(len(mask) - 1)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        make = Templates()
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                raw, forms, plain = make.tokens(body)
                for width in widths:
                    at, found = make.raw_windows(*plain, width, least_fixed)
                    for i in np.flatnonzero(mask[(found & bits).astype(np.int64)]):
                        rows.append((doc, int(found[i].view(np.int64)), int(at[i]), []))
                for (hashes, kind), width in product(forms, widths):
                    at, found = make.windows(hashes, kind, width, least_fixed)
                    for i in np.flatnonzero(mask[(found & bits).astype(np.int64)]):
                        rows.append((doc, int(found[i].view(np.int64)), int(at[i]), slots(raw, kind, int(at[i]), width)))
            if rows:
                doc, h, at, values = zip(*rows)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc, pa.int64()), "hash": pa.array(h, pa.int64()), "pos": pa.array(at, pa.int32()),
                    "doc_slots": pa.array(values, pa.list_(pa.string())),
                })

    source = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("body")).where(F.length("body") > 0)
    return source.mapInArrow(run, "doc_id bigint, hash bigint, pos int, doc_slots array<string>")


def _largest(windows: list, width: int, side: int) -> int:
    """Cover of the largest set of windows in which a value of ``side`` (0: item, 1: document) has one partner.

    A search over the values with several partners, best supported ones first. It is exact
    within ``TRIES`` steps; beyond them the best set found so far counts.
    """
    todo, best, tries = [windows], -1, 0
    while todo and (tries < TRIES or best < 0):
        rest = todo.pop()
        tries += 1
        cover = _cover(rest, width)
        if cover <= best:
            continue
        votes: dict = {}
        for _, pairs in rest:
            for p in pairs:
                partners = votes.setdefault(p[side], {})
                partners[p] = partners.get(p, 0) + 1
        torn = max((v for v in votes.values() if len(v) > 1), key=lambda v: sum(v.values()), default=None)
        if torn is None:
            best = cover
            continue
        choices = [None, *sorted(torn, key=lambda p: (torn[p], p))]  # the last is tried first; None: no window with this value
        todo += [[w for w in rest if not any(p in torn and p != choice for p in w[1])] for choice in choices]
    return best


def _cover(windows: list, width: int) -> int:
    """Tokens in the union of the windows."""
    end = total = 0
    for at in sorted({at for at, _ in windows}):
        total += at + width - max(at, end)
        end = at + width
    return total


def agreement(windows: list, width: int, n_tokens: int, least_cover: float, enough: int) -> tuple[int, bool] | None:
    """(cover, changed): tokens of the agreeing windows of one alignment, and whether any window holds other values; None if too few.

    ``windows`` are (start, [(item value, document value), ...]).
    """
    windows = [(at, frozenset((p[0], p[1]) for p in pairs)) for at, pairs in windows]
    same = [w for w in windows if all(i == d for i, d in w[1])]
    kept = {i for _, pairs in windows for i, d in pairs if i == d}
    sound = [w for w in windows if not any(i != d and i in kept for i, d in w[1])]
    against = _cover(windows, width) - _cover(sound, width)
    cover = max(_cover(same, width), _largest(sound, width, 0), _largest(sound, width, 1))
    return (cover, len(same) < len(windows)) if cover >= enough or cover - against >= least_cover * n_tokens else None


def leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
    window: int = WINDOW, least_fixed: int = LEAST_FIXED, least_cover: float = LEAST_COVER, enough: int = ENOUGH,
) -> DataFrame:
    """One row per contaminated document: doc_id, ``items`` (sorted), ``covered`` (most tokens of an item), ``changed`` (with other values)."""
    items = materialize(item_windows(benchmark, item_text, item_key, window, least_fixed), "benchmark-windows")
    mask = np.zeros(MASK_BITS, bool)
    mask[items.select(F.col("hash").bitwiseAND(MASK_BITS - 1).alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)] = True
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most ``window`` of them
    found = document_windows(docs, text, key, mask, widths, least_fixed)

    pair = lambda d, i: F.struct(i.alias("item"), d.alias("doc"))
    matched = found.join(items, "hash").withColumn("pairs", F.zip_with("doc_slots", "item_slots", pair))
    # sets are bounded by the tokens of an item
    aligned = matched.groupBy("doc_id", "item", (F.col("pos") - F.col("at")).alias("offset")).agg(
        F.sort_array(F.collect_set(F.struct("at", "pairs"))).alias("windows"), F.first("width").alias("width"), F.first("n_tokens").alias("n_tokens"),
    )
    # all windows together cover at least as much as those that agree
    starts = F.array_distinct(F.col("windows.at"))
    most = F.aggregate(
        F.transform(starts, lambda at, i: F.least(F.col("width"), F.coalesce(F.get(starts, i + 1) - at, F.col("width")))), F.lit(0), lambda a, x: a + x
    )
    agree = F.udf(lambda windows, width, n: agreement(windows, width, n, least_cover, enough), "covered int, changed boolean")
    judged = aligned.where((most >= least_cover * F.col("n_tokens")) | (most >= enough)).withColumn(
        "agreed", agree("windows", "width", "n_tokens")
    ).where("agreed is not null").select("doc_id", "item", "agreed.*")
    return judged.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item")).alias("items"), F.max("covered").cast("long").alias("covered"), F.max("changed").alias("changed")
    ).withColumnRenamed("doc_id", key)
