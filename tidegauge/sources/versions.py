"""Stored tables whose readers see one version: data folders, and a small record of the live ones.

    data/v=<folder>/<partition>=<value>/…   parquet, written once, never changed
    marks/<folder>/…                        keys deleted since
    commits/<number>.json                   live folders of every partition, marks, last batch of each writer

A change writes its data beside the live one, then a record under a temporary name, and
renames that record to the next number. The rename fails where the number is taken, so
of two writers one starts again from the newer version. Whatever stops before the rename
leaves the table as it was; a batch that is replayed after it is found in the record and
does nothing. The record grows with the number of partitions, not with the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import discard, materialize, workspace

ATTEMPTS = 8
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # how Spark names the partition of a null
EMPTY = {"version": 0, "schema": None, "live": {}, "marks": [], "writers": {}}


class ConcurrentChange(RuntimeError):
    """Another writer has changed the same partitions."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition: str = "day"):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition

    # --- files ---------------------------------------------------------------------

    def _hadoop(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _listed(self, folder: str) -> list:
        files, at = self._hadoop(f"{self.path}/{folder}")
        return list(files.listStatus(at)) if files.exists(at) else []

    def _text(self, path: str) -> str:
        files, at = self._hadoop(path)
        stream = files.open(at)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _rename_new(self, source: str, target: str) -> bool:
        """Renames; false if the target exists."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        hadoop = jvm.org.apache.hadoop.fs
        a, b = hadoop.Path(source), hadoop.Path(target)
        context = hadoop.FileContext.getFileContext(self._hadoop(source)[0].getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(a, b, gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    # --- versions --------------------------------------------------------------------

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._listed("commits"))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def record(self, version: int | None = None) -> dict:
        """The record of a version, the newest by default; an empty one if there is none."""
        known = self.versions()
        if not known:
            return json.loads(json.dumps(EMPTY))
        return json.loads(self._text(f"{self.path}/commits/{version or known[-1]:020d}.json"))

    def _commit(self, change: Callable[[dict], dict | None], base: dict | None = None, touched: Iterable[str] = ()) -> dict:
        """Applies ``change`` to the newest record; fails if ``touched`` partitions are no longer as in ``base``."""
        touched = list(touched)
        for _ in range(ATTEMPTS):
            now = self.record()
            if base is not None and any(now["live"].get(p) != base["live"].get(p) for p in touched):
                raise ConcurrentChange(self.path)
            new = change(json.loads(json.dumps(now)))
            if new is None:
                return now
            new["version"] = now["version"] + 1
            files, _ = self._hadoop(self.path)
            aside = f"{self.path}/commits/_{uuid.uuid4().hex}"
            out = files.create(self._hadoop(aside)[1])
            try:
                out.write(bytearray(json.dumps(new).encode()))
            finally:
                out.close()
            if self._rename_new(aside, f"{self.path}/commits/{new['version']:020d}.json"):
                return new
            discard(self.spark, aside)
        raise ConcurrentChange(self.path)

    @staticmethod
    def _done(record: dict, writer: str | None, batch: int | None) -> bool:
        return writer is not None and batch is not None and record["writers"].get(writer, -1) >= batch

    # --- reading ---------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of one version; None before the first."""
        record = self.record(version)
        return None if record["schema"] is None else self._rows(record)

    def _rows(self, record: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(record["schema"]))
        paths = [f"{self.path}/data/v={e['folder']}/{part}" for part, entries in record["live"].items() for e in entries]
        if not paths:
            return self.spark.createDataFrame([], schema)
        known = T.StructType([*schema.fields, T.StructField("v", T.StringType())])
        rows = self.spark.read.schema(known).option("basePath", f"{self.path}/data").parquet(*paths)
        if record["marks"]:
            rows = self._unmarked(rows, record)
        return rows.select(*schema.names)

    def _unmarked(self, rows: DataFrame, record: dict) -> DataFrame:
        """Leaves out rows that were written before their key was deleted."""
        since = {e["folder"]: e["since"] for entries in record["live"].values() for e in entries}  # as many as live folders
        ages = self.spark.createDataFrame(list(since.items()), "v string, _since bigint")
        keys = record["marks"][0]["keys"]
        marks = None
        for mark in record["marks"]:  # folded in by compaction
            part = self.spark.read.parquet(f"{self.path}/marks/{mark['folder']}").select(*keys, F.lit(mark["since"]).cast("bigint").alias("_deleted"))
            marks = part if marks is None else marks.unionByName(part)
        marks = marks.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("_deleted").alias("_deleted"))
        met = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_since") < F.col("_deleted")]
        return rows.join(F.broadcast(ages), "v").join(marks, met, "left_anti")

    # --- writing ---------------------------------------------------------------------

    def _write(self, rows: DataFrame, **options: str) -> tuple[str, list[str]]:
        """Writes a data folder; returns its name and the partitions in it."""
        folder = uuid.uuid4().hex
        rows.write.options(**options).partitionBy(self.partition).parquet(f"{self.path}/data/v={folder}")
        names = [s.getPath().getName() for s in self._listed(f"data/v={folder}")]
        return folder, sorted(n for n in names if n.startswith(f"{self.partition}="))

    def _schema(self, rows: DataFrame) -> str:
        fields = [f for f in rows.schema.fields if f.name != self.partition] + [rows.schema[self.partition]]
        return T.StructType([T.StructField(f.name, f.dataType) for f in fields]).json()

    def _dealt(self, rows: DataFrame) -> DataFrame:
        # the rebalance splits a huge partition over many tasks and keeps a small one in one file
        return rows.hint("rebalance", F.col(self.partition))

    def append(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> dict:
        """Adds rows. A batch that is already in does nothing."""
        if self._done(self.record(), writer, batch):
            return self.record()
        folder, parts = self._write(self._dealt(rows))

        def change(record: dict) -> dict | None:
            if self._done(record, writer, batch):
                return None
            for part in parts:
                record["live"].setdefault(part, []).append({"folder": folder, "since": record["version"] + 1})
            return self._noted(record, rows, writer, batch)

        return self._commit(change)

    def _noted(self, record: dict, rows: DataFrame, writer: str | None, batch: int | None) -> dict:
        record["schema"] = record["schema"] or self._schema(rows)
        if writer is not None and batch is not None:
            record["writers"][writer] = batch
        return record

    def _replaced(self, rows: DataFrame, base: dict, gone: Iterable[str], writer=None, batch=None, layout: str = "", **options: str) -> dict:
        """Puts ``rows`` in place of the partitions that they hold and of those in ``gone``."""
        folder, parts = self._write(rows, **options)
        gone = sorted(set(gone) | set(parts))

        def change(record: dict) -> dict:
            for part in gone:
                record["live"].pop(part, None)
            for part in parts:
                record["live"][part] = [{"folder": folder, "since": record["version"] + 1, "layout": layout}]
            return self._noted(record, rows, writer, batch)

        return self._commit(change, base, gone)

    def replace(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> dict:
        """Replaces the partitions that ``rows`` hold."""
        base = self.record()
        return base if self._done(base, writer, batch) else self._replaced(self._dealt(rows), base, (), writer, batch)

    def upsert(self, changes: DataFrame, keys: list[str], newest: str | None = None, writer: str | None = None, batch: int | None = None) -> dict:
        """Inserts or replaces by key within the partitions that ``changes`` hold.

        Of rows with one key the one with the largest ``newest`` value wins; a hash of the
        whole row settles ties the same way on every attempt. The changes are stored
        once, as they are read more than once; the merged partitions are written once.
        """
        order = Window.partitionBy(*keys).orderBy(
            *([F.col(newest).desc()] if newest else []), F.xxhash64(F.to_json(F.struct(*changes.columns))))
        fresh = changes.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
        scratch = workspace(self.spark, "upsert")
        try:
            base = self.record()
            if self._done(base, writer, batch):
                return base
            fresh = materialize(fresh, "upsert", scratch)
            held = fresh.select(F.col(self.partition).cast("string")).distinct().collect()  # one row per partition
            touched = {NO_VALUE if r[0] is None else r[0] for r in held}
            for _ in range(ATTEMPTS):
                merged = fresh
                if base["schema"] is not None:
                    old = self._rows(base | {"live": {p: e for p, e in base["live"].items() if self.value(p) in touched}})
                    merged = old.join(fresh.select(*keys), keys, "left_anti").select(*fresh.columns).unionByName(fresh)
                try:
                    return self._replaced(self._dealt(merged), base, (), writer, batch)
                except ConcurrentChange:
                    base = self.record()
                    if self._done(base, writer, batch):
                        return base
            raise ConcurrentChange(self.path)
        finally:
            discard(self.spark, scratch)

    def delete(self, keys: DataFrame, writer: str | None = None, batch: int | None = None) -> dict:
        """Marks keys as deleted: their rows of earlier versions are no longer read. No data file is written."""
        if self._done(self.record(), writer, batch):
            return self.record()
        folder, names = uuid.uuid4().hex, keys.columns
        keys.distinct().write.parquet(f"{self.path}/marks/{folder}")

        def change(record: dict) -> dict | None:
            if self._done(record, writer, batch):
                return None
            if any(m["keys"] != names for m in record["marks"]):
                raise ValueError("marks of one table have the same key columns")
            record["marks"].append({"folder": folder, "since": record["version"] + 1, "keys": names})
            if writer is not None and batch is not None:
                record["writers"][writer] = batch
            return record

        return self._commit(change)

    # --- upkeep ----------------------------------------------------------------------

    def value(self, part: str) -> str:
        return unquote(part.split("=", 1)[1])

    def expire(self, before: str) -> list[str]:
        """Drops partitions whose value is smaller; returns their values. Only the record is written."""
        gone: list[str] = []

        def change(record: dict) -> dict | None:
            gone[:] = sorted(p for p in record["live"] if self.value(p) < before and self.value(p) != NO_VALUE)
            for part in gone:
                del record["live"][part]
            return record if gone else None

        self._commit(change)
        return [self.value(p) for p in gone]

    def compact(self, segment: str, order: str, before: str | None = None, salts: int = 8) -> list[str]:
        """Rewrites partitions in place: by ``segment``, newest first, strongly compressed, marks applied.

        Partitions that are compact already are left alone, unless a mark is newer. The
        salt splits one segment that owns a partition. Marks that no live folder is
        older than are forgotten. Returns the values of the rewritten partitions.
        """
        base = self.record()
        marked = max([m["since"] for m in base["marks"]], default=0)
        parts = [p for p, entries in base["live"].items() if (before is None or self.value(p) < before)
                 and not (len(entries) == 1 and entries[0].get("layout") == "compact" and entries[0]["since"] >= marked)]
        if parts:
            rows = self._rows(base | {"live": {p: base["live"][p] for p in parts}})
            salt = F.pmod(F.xxhash64(order), F.lit(salts))
            rows = rows.repartition(self.partition, segment, salt).sortWithinPartitions(self.partition, segment, F.col(order).desc())
            self._replaced(rows, base, parts, layout="compact", compression="zstd")

        def forget(record: dict) -> dict | None:
            oldest = min([e["since"] for entries in record["live"].values() for e in entries], default=record["version"] + 1)
            kept = [m for m in record["marks"] if m["since"] > oldest]
            if len(kept) == len(record["marks"]):
                return None
            return record | {"marks": kept}

        self._commit(forget)
        return sorted(map(self.value, parts))

    def vacuum(self, keep: int = 1, older_than_hours: float = 24) -> int:
        """Deletes folders that none of the last ``keep`` versions names, and older records; returns how many.

        Folders younger than the limit stay, as a writer may be about to name them.
        """
        known = self.versions()
        records = [self.record(v) for v in known[-keep:]]
        named = {f"v={e['folder']}" for r in records for entries in r["live"].values() for e in entries}
        named |= {m["folder"] for r in records for m in r["marks"]} | {f"{v:020d}.json" for v in known[-keep:]}
        limit = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis() - int(older_than_hours * 3600_000)
        gone = [s.getPath() for folder in ("data", "marks", "commits") for s in self._listed(folder)
                if s.getPath().getName() not in named and s.getModificationTime() <= limit]
        for at in gone:
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return len(gone)
