"""Token-id output: documents encoded in key order into patched frame-of-reference files.

``write_ids`` range-partitions documents by key, so each task writes one file and the
files follow each other in key order. ``read_ids`` decodes the files again and gives
every document its place among all ids.

Defined results: a null text counts as empty, so it yields the end id alone; null keys
come first, repeated keys stand side by side in the order of a hash of their text; extra
columns are ignored; an empty table gives no file and no row. Special strings inside a
text are treated as the tokenizers library does by default.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import files, pfor, pieces
from tidegauge.session import materialize, workspace

#: Chunks that one Python worker remembers.
REMEMBERED = 1_000_000
#: Characters of text that are encoded together; a longer text stands alone.
TOGETHER = 4 << 20
#: Pre-tokens in one call of the model, and the byte between them.
PARTED, MARK = 256, b"\xff"


class Encoder:
    """Ids of whole texts; chunks that encode alone are encoded once and remembered.

    The chunks of several texts are counted off by Arrow, so that a chunk is looked up once
    however often it stands there. New chunks whose characters no Unicode version disputes
    are cut into pre-tokens, which go to the library's model as they are, many in one call; all
    others go through the whole library.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.library = pieces.load(path)
        self.bare = pieces.bare(self.library)
        chars = pieces.byte_chars()
        self.chars = np.array([ord(c) for c in chars], "<u2")
        self.special = pieces.special_pattern(pieces.specials(path))
        #: Id of the byte that UTF-8 never holds; it parts pre-tokens if no merge takes it in.
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.mark = vocabulary.get(chars[255]) if sum(chars[255] in t for t in vocabulary) == 1 else None
        self.remembered = remembered
        self.first = pieces.Chunks(self._whole, remembered)
        self._forget()

    def _forget(self) -> None:
        #: Number of a chunk, that is of text behind a space; and of a pre-token without a space.
        self.rest: dict[str, int] = {}
        self.known: dict[str, int] = {}
        #: Ids of number k: ids[ends[k]:ends[k + 1]].
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """New numbers."""
        first = len(self.ends) - 1
        self.ids = np.concatenate((self.ids, ids))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)))
        return range(first, len(self.ends) - 1)

    def _kept(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids behind the numbers, side by side, and how many each has."""
        import pyarrow as pa

        lists = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(self.ids))
        return lists.take(pa.array(numbers)).values.to_numpy(), self.ends[numbers + 1] - self.ends[numbers]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pretokens(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens, side by side, and how many each has."""
        out, sizes, many = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], PARTED if self.mark is not None else 1
        for at in range(0, len(found), many):
            raw = np.frombuffer(MARK.join(map(str.encode, found[at:at + many])), np.uint8)
            piece = self.chars[raw].tobytes().decode("utf-16-le")
            ids = np.array(self.bare.encode_batch_fast([piece], add_special_tokens=False)[0].ids, np.uint32)
            marks = ids == self.mark if many > 1 else np.zeros(len(ids), bool)
            out.append(ids[~marks])
            sizes.append(np.diff(np.flatnonzero(marks), prepend=-1, append=len(ids)) - 1)
        return np.concatenate(out), np.concatenate(sizes)

    def _learn(self, chunks: list[str]) -> list[int]:
        """Numbers of chunks that have none."""
        plain, mixed, odd = [], [], []
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():
                plain.append(chunk)
            elif not chunk or chunk != chunk.strip() or pieces.DISPUTED.search(chunk):
                odd.append(chunk)
            else:
                mixed.append(chunk)
        if odd:
            ids = [self._whole(" " + chunk) for chunk in odd]
            self.rest.update(zip(odd, self._keep(np.concatenate(ids), [len(i) for i in ids])))
        found = pieces.PRETOKENS.findall(" " + " ".join(mixed)) if mixed else []
        # a chunk has one pre-token that begins with a space, its first, which is a chunk too
        begins = [p[0] == " " for p in found]
        heads, inner = [p[1:] for p, first in zip(found, begins) if first], [p for p, first in zip(found, begins) if not first]
        new_heads = [c for c in dict.fromkeys(plain + heads) if c not in self.rest]
        new_inner = [p for p in dict.fromkeys(inner) if p not in self.known]
        numbers = self._keep(*self._pretokens([" " + c for c in new_heads] + new_inner))
        self.rest.update(zip(new_heads, numbers))
        self.known.update(zip(new_inner, numbers[len(new_heads):]))
        if mixed:
            first, every = np.array(begins), np.zeros(len(found), np.int64)
            every[first] = list(map(self.rest.__getitem__, heads))
            every[~first] = list(map(self.known.__getitem__, inner))
            ids, sizes = self._kept(every)
            self.rest.update(zip(mixed, self._keep(ids, np.add.reduceat(sizes, np.flatnonzero(first)))))
        return list(map(self.rest.__getitem__, chunks))

    def _behind(self, tails: list[str]) -> Iterator[np.ndarray]:
        """Ids of texts that each stand behind a space."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if max(len(self.rest), 4 * len(self.known), len(self.ids) // 16) >= self.remembered:
            self._forget()
        parts = pc.split_pattern(pa.array(tails, pa.string()), " ")
        coded = pc.dictionary_encode(parts.values)
        whole = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        chunks = pc.binary_join(whole, " ")[0].as_py().split(" ")
        numbers = list(map(self.rest.get, chunks))
        if new := [c for c, known in zip(chunks, numbers) if known is None]:
            learned = iter(self._learn(new))
            numbers = [next(learned) if known is None else known for known in numbers]
        del chunks, whole, new
        ids, sizes = self._kept(np.array(numbers, np.int32)[coded.indices.to_numpy()])
        ends = np.concatenate(([0], np.cumsum(sizes)))[parts.offsets.to_numpy()].tolist()
        return (ids[a:b] for a, b in zip(ends, ends[1:]))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        out, spaced, tails = [], [], []
        for at, text in enumerate(texts):
            if pieces.has_runs(text) or self.special and self.special.search(text):
                out.append(self._whole(text))
                continue
            head, space, tail = text.partition(" ")
            out.append(self.first[head])
            if space:
                spaced.append(at)
                tails.append(tail)
        if tails:
            for at, ids in zip(spaced, self._behind(tails)):
                out[at] = np.concatenate((out[at], ids))
        return out


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> Encoder:
    """One per Python worker, so that later tasks find what earlier ones encoded."""
    return Encoder(path)


def together(rows: Iterator[tuple], size: int = TOGETHER) -> Iterator[list[tuple]]:
    """Rows of key and text in lists of at most about so many characters."""
    held, length = [], 0
    for row in rows:
        if held and length + len(row[1]) > size:
            yield held
            held, length = [], 0
        held.append(row)
        length += len(row[1])
    if held:
        yield held


def write_ids(
    docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", tokenizer: str | None = None,
    end_id: int = 0, percentile: float = 0.9, batch: int = 512,
) -> DataFrame:
    """Writes the files; returns the manifest: part, path, n_docs, n_ids, start (ids before the file)."""
    source = docs.select(docs[key].cast("bigint").alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    place = [F.col("key"), F.xxhash64("text")]
    ordered = source.repartitionByRange(*place).sortWithinPartitions(*place)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, end = shared_encoder(tokenizer or pieces.default_path()), np.array([end_id], np.uint32)
        path = files.attempt_name(folder, ".pfor")
        rows = ((b.slice(at, batch)) for b in batches for at in range(0, b.num_rows, batch))
        parts = together((k, t) for part in rows for k, t in zip(part.column("key").to_pylist(), part.column("text").to_pylist()))
        first = next(parts, None)
        if first is None:
            return
        with files.writing(path) as out:
            writer = pfor.Writer(out, percentile)
            part = first
            while part is not None:
                keys, texts = zip(*part)
                for k, ids in zip(keys, encoder(texts)):
                    writer.add(k, np.concatenate((ids, end)))
                part = next(parts, None)
            writer.close()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": pa.array([path]),
            "n_docs": pa.array([len(writer.keys)], pa.int64()), "n_ids": pa.array([writer.total], pa.int64()),
        })

    manifest = ordered.mapInArrow(run, "part int, path string, n_docs bigint, n_ids bigint")
    manifest = materialize(manifest, "manifest", f"{folder.rstrip('/')}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, start, n_tokens and ``ids`` (little-endian unsigned 32-bit) of every document in the files."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows():
            for batch in batches:
                for path, start, n_docs, n_ids in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "n_docs", "n_ids"))):
                    with files.reading(path) as source:
                        reader = pfor.Reader(source)
                        if (len(reader.keys), reader.total) != (n_docs, n_ids):
                            raise ValueError(f"{path} does not hold what the manifest says")
                        for k, at, ids in reader.documents():
                            yield k, start + at, len(ids), ids.astype("<u4").tobytes()

        held, size = [], 0
        for row in rows():
            held.append(row)
            size += len(row[3])
            if size >= 4 << 20:
                yield record(pa, held)
                held, size = [], 0
        if held:
            yield record(pa, held)

    def record(pa, held):
        keys, starts, counts, ids = zip(*held)
        return pa.RecordBatch.from_pydict({
            "key": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int64()),
            "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(ids, pa.binary()),
        })

    n_files = max(1, manifest.count())
    parts = manifest.select("path", "start", "n_docs", "n_ids").repartition(n_files)
    return parts.mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids binary").withColumnRenamed("key", key)


def stored_ids(docs: DataFrame, **options) -> tuple[DataFrame, str]:
    """Writes and reads back; also the folder, which the caller discards when done."""
    folder = workspace(docs.sparkSession, "token-ids")
    return read_ids(write_ids(docs, folder, **options), options.get("key", "doc_id")), folder
