"""Token counts: the exact count of every prefix, by dynamic programming over tokens.

The encoding of a prefix ends with token t exactly if the encoding of the prefix without
t ends with some token p such that p and t, encoded together, stay p and t. At each byte
one vocabulary entry alone fulfils this, so ``count[k] = count[k - len(t)] + 1`` gives the
count of every prefix in one pass. The table of a text is kept as one signed byte per
byte of text: the change of the count. Truncation and budget questions are answered from
the table, the text is never encoded again.

Defined results: a null text counts as empty; an empty text has 0 tokens and an empty
table; repeated rows give repeated rows; extra columns are not carried along, whatever
their names; an empty table gives an empty table. Prefixes that cut a character count
its bytes so far.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import pieces

#: Chunks that one Python worker remembers.
REMEMBERED = 700_000

CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixTable:
    """Changes of the token count, byte by byte, for one vocabulary."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        chars = pieces.byte_chars()
        self.chars = dict(enumerate(chars))
        #: Tokens by the order in which merges make them: bytes first.
        self.order = {c: i for i, c in enumerate(chars)}
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * 256
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            own = self.order.setdefault(left + right, len(self.halves))
            if own == len(self.halves):
                self.halves.append((self.order[left], self.order[right]))
            self.joined.setdefault((self.order[left], self.order[right]), own)
        self.longest = max(map(len, self.order))
        #: Length of the longest token by its last three characters.
        self.reach: dict[str, int] = {}
        for token in self.order:
            if len(token) > 2:
                self.reach[token[-3:]] = max(self.reach.get(token[-3:], 0), len(token))
        self.library = pieces.load(path)
        self.special = pieces.special_pattern(pieces.specials(path))
        self.pairs: dict[tuple[int, int], bool] = {}
        #: Count and last token of beginnings seen before.
        self.ends: dict[str | None, tuple[int, int]] = {}
        self.remembered = remembered
        self.changes = pieces.Chunks(self._changes, remembered // 4)
        self.first = pieces.Chunks(self._chunk, remembered)
        self.rest = pieces.Chunks(lambda c: self._chunk(" " + c), remembered)

    def _apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay two.

        Their merges are undone from the latest one on; each step looks at the two parts
        that then meet at the seam. The tokens join if those parts have a merge that
        comes before the merge just undone.
        """
        before = len(self.halves)
        while True:
            whole = self.joined.get((left, right))
            if whole is not None and whole < before:
                return False
            # of equal merges the left one runs first, so the right one is undone first
            if left > right and self.halves[left]:
                before, left = left, self.halves[left][1]
            elif self.halves[right]:
                before, right = right + 1, self.halves[right][0]
            elif self.halves[left]:
                before, left = left, self.halves[left][1]
            else:
                return True

    def counts(self, pretoken: str) -> list[int]:
        """Token count of every byte prefix of a pre-token, the empty one first."""
        piece = "".join(map(self.chars.__getitem__, pretoken.encode()))
        count, last = [0], [-1]
        order, pairs, longest, ends, reach = self.order, self.pairs, self.longest, self.ends, self.reach
        if len(pairs) >= self.remembered:
            pairs.clear()
        if len(ends) >= self.remembered:
            ends.clear()
        for end in range(1, len(piece) + 1):
            prefix = piece[:end] if end <= longest else None
            known = ends.get(prefix)
            if known is not None:  # other pre-tokens began alike
                count.append(known[0])
                last.append(known[1])
                continue
            far = reach.get(piece[end - 3:end], 2) if end > 2 else 2
            for start in range(end - far if end > far else 0, end):
                token = order.get(piece[start:end])
                if token is not None:
                    if start:
                        pair = (last[start], token)
                        fits = pairs.get(pair)
                        if fits is None:
                            fits = pairs[pair] = self._apart(*pair)
                        if not fits:
                            continue
                    count.append(count[start] + 1)
                    last.append(token)
                    break
            if prefix is not None:
                ends[prefix] = (count[end], last[end])
        return count

    def _changes(self, pretoken: str) -> bytes:
        # a shorter prefix of a contraction is no contraction but a mark and letters
        count = self.counts(pretoken) if pretoken not in CONTRACTIONS else [0, 1, 2, self.counts(pretoken)[-1]]
        return bytes([(b - a) & 255 for a, b in zip(count, count[1:])])

    def _pretokens(self, text: str) -> list[str]:
        if not pieces.DISPUTED.search(text):
            return pieces.PRETOKENS.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)] if text else []

    def _chunk(self, text: str) -> bytes:
        found = self._pretokens(text)
        out = b"".join(map(self.changes.__getitem__, found))
        return self._whole_runs(found, out) if any(a[-1].isspace() for a in found[:-1]) else out

    def _whole_runs(self, found: list[str], changes: bytes) -> bytes:
        """A prefix that ends with a run of white space has the run in one pre-token."""
        table, at = np.frombuffer(changes, np.int8).copy(), 0
        for a, b in zip(found, found[1:]):
            at += len(a.encode())
            if a.isspace() and b[0].isspace():
                head = len(b[0].encode())
                whole, apart = self.counts(a + b[0])[-1], self.counts(a)[-1] + self.counts(b)[head]
                if whole != apart:
                    table[at + head - 1] += whole - apart
                    table[at + head] -= whole - apart
        return table.tobytes()

    def _ordinary(self, text: str) -> bytes:
        if pieces.has_runs(text) or not text.isascii() and pieces.DISPUTED.search(text):
            return self._chunk(text)
        head, *tail = text.split(" ")
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail))

    def table(self, text: str) -> bytes:
        """Change of the token count at each byte of the text."""
        parts = pieces.segments(text, self.special)
        if len(parts) == 1:
            return self._ordinary(text)
        out = []
        for at in range(0, len(parts), 2):
            own = self._ordinary(parts[at])
            if at + 1 < len(parts):  # its string is one token as a whole, ordinary text up to its last byte
                total = int(np.frombuffer(own, np.int8).sum(dtype=np.int64)) + 1
                own = self._ordinary(parts[at] + parts[at + 1][:-1])
                seen = int(np.frombuffer(own, np.int8).sum(dtype=np.int64))
                own += np.int8(total - seen).tobytes()
            out.append(own)
        return b"".join(out)


@lru_cache(maxsize=2)
def shared_table(path: str) -> PrefixTable:
    """One per Python worker, so that later tasks find what earlier ones worked out."""
    return PrefixTable(path)


def tokens_at(table: bytes, n_bytes: int) -> int:
    """Tokens of the prefix of so many bytes."""
    return int(np.frombuffer(table, np.int8, min(n_bytes, len(table))).sum(dtype=np.int64)) if table else 0


def longest_within(table: bytes, budget: int) -> int:
    """Bytes of the longest prefix of at most ``budget`` tokens."""
    over = np.flatnonzero(np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)[::-1] <= budget)
    return len(table) - int(over[0]) if len(over) else 0


def prefix_counts(
    docs: DataFrame, text: str = "text", key: str = "doc_id", budgets: tuple[int, ...] = (1024,),
    tokenizer: str | None = None, keep_table: bool = True,
) -> DataFrame:
    """One row per document: its key, ``n_bytes``, ``n_tokens``, ``cuts`` (for each budget the bytes of
    the longest prefix within it) and, unless ``keep_table`` is false, ``prefix_table``."""
    source = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = shared_table(tokenizer or pieces.default_path())
        for batch in batches:
            tables = [counter.table(t) for t in batch.column("text").to_pylist()]
            columns = {
                "key": batch.column("key"),
                "n_bytes": pa.array([len(t) for t in tables], pa.int64()),
                "n_tokens": pa.array([tokens_at(t, len(t)) for t in tables], pa.int64()),
                "cuts": pa.array([[longest_within(t, b) for b in budgets] for t in tables], pa.list_(pa.int64())),
            }
            if keep_table:
                columns["prefix_table"] = pa.array(tables, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_bytes bigint, n_tokens bigint, cuts array<bigint>" + ", prefix_table binary" * keep_table
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def tokens_of_prefix(table: Column, n_bytes: Column) -> Column:
    """Tokens of a prefix, from a stored table and in the JVM: a sum over signed bytes."""
    codes = F.substring(F.hex(table), F.lit(1), (2 * n_bytes).cast("int"))
    steps = F.transform(
        F.sequence(F.lit(1), F.length(codes) - 1, F.lit(2)),
        lambda i: F.conv(F.substring(codes, i, F.lit(2)), 16, 10).cast("long"),
    )
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x - F.when(x > 127, 256).otherwise(0))
    return F.when(F.length(codes) > 0, total).otherwise(F.lit(0).cast("long"))
