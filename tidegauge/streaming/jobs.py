"""Structured Streaming jobs: telemetry to capsules, capsules to vectors."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidegauge.constants import BUCKET, LATENESS, MAX_SAMPLES, SEVERITIES
from tidegauge.functions.text import template_messages
from tidegauge.operators.capsules import KEY, capsule_id, capsule_totals, describe_totals, ready_for_embedding, split_valid
from tidegauge.operators.vectors import Embedder, embed_with
from tidegauge.schemas import EMBEDDING, TELEMETRY
from tidegauge.sources.stores import read_or_none, read_table
from tidegauge.sources.versions import VersionedTable
from tidegauge.streaming.sinks import batch_writer, upsert_writer, with_fallback

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # one stateful operator per job: late rows meet the newest watermark, not the one before
    "spark.sql.streaming.statefulOperator.allowMultiple": "false",
}

KEYS = ["template", "service_name", "time_bucket"]
BUCKET_SECONDS = 3600
#: Parts of a capsule's state, so that a hot template is not one key.
SALTS = 4
#: Shares of an hour's capsules; a share's state is in memory while its rows are added.
SHARES = 8
#: Rows of a share that a task holds.
ROWS_AT_ONCE = 10_000


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """Settings of a stream that is started inside, which keeps them; the session's own come back."""
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


#: The topic of raw telemetry, read from its beginning; offsets are the engine's.
TOPIC = {"subscribe": "raw-telemetry", "startingOffsets": "earliest"}


def telemetry_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None, **options: str) -> DataFrame:
    """A stream of encoded rows, one ``value`` each: a topic (which needs the connector jar), or text files."""
    if fmt == "kafka":
        options = TOPIC | options
    return spark.readStream.format(fmt).options(**options).load(path).select("value")


def decoded(stream: DataFrame, schema: T.StructType = TELEMETRY, options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters) of a stream of JSON values.

    A value that is no JSON object, or holds a field that does not fit its type, becomes a
    dead letter ``value`` (its bytes), ``reason`` and ``timestamp``. Unknown fields are ignored.
    """
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    row = F.from_json(F.col("value").cast("string"), whole, {"columnNameOfCorruptRecord": "_bad"} | (options or {}))
    read = stream.select(F.col("value").cast("binary").alias("value"), row.alias("row"))
    broken = F.col("row").isNull() | F.col("row._bad").isNotNull() | ~F.coalesce(
        F.ltrim(F.col("value").cast("string")).startswith("{"), F.lit(False))
    dead = read.filter(broken).select("value", F.lit("undecodable").alias("reason"), F.current_timestamp().alias("timestamp"))
    return read.filter(~broken).select(*[F.col(f"row.`{n}`").alias(n) for n in schema.names]), dead


def running_totals(events: DataFrame, mode: str = "compat", lateness: str = LATENESS) -> DataFrame:
    """Totals per template, service and hour; each change re-emits the full new total.

    A built-in windowed aggregate: rows are combined before the shuffle, the state holds
    a few numbers per capsule, and a late row counts until the watermark passes the end
    of its hour.
    """
    valid, _ = split_valid(events)
    rows = template_messages(valid.withWatermark("timestamp", lateness), mode=mode)
    totals = capsule_totals(rows, ["template", "service_name", F.window("timestamp", BUCKET).alias("hour")])
    return totals.withColumn("time_bucket", F.col("hour.start")).drop("hour")


def start_totals(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, mode: str = "compat"
) -> StreamingQuery:
    with state_settings(events.sparkSession):
        return (
            running_totals(events, mode).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(batch_writer(path)).trigger(**(trigger or {"processingTime": "5 minutes"})).start()
        )


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest total of every key. A key changes in the few batches of its hour."""
    measures = ["count", "first_seen_at", "last_seen_at", *[f"_{s}" for s in SEVERITIES]]
    newest = spark.read.parquet(path).groupBy(*KEYS).agg(F.max_by(F.struct(*measures), "batch_id").alias("t"))
    return describe_totals(newest.select(*KEYS, "t.*"))


_CAPSULE = "template string, service_name string, first bigint, last bigint, n bigint, severities array<bigint>, hashes array<string>, ids array<string>"
_STATE = "capsules array<struct<" + _CAPSULE.replace(" bigint", ": bigint").replace(" string", ": string").replace(" array", ": array") + ">>"
_UPDATE = "bucket bigint, salt bigint, " + _CAPSULE
_UPDATE_NAMES = [c.split()[0] for c in _UPDATE.split(", ")]
_ROW = ["template", "service_name", "micros", "severity", "hash", "event_id"]


class CapsuleState(StatefulProcessor):
    """Totals and the ten smallest id hashes of the capsules of one share of an hour, until the hour is closed.

    A call to the state costs far more than the rows of a small capsule, so a share's
    capsules are read and written together. Every batch emits the full new value of the
    capsules that it changes. A timer at the end of the hour drops the state once the
    watermark is past it; later rows of that hour no longer reach it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.capsule = handle.getValueState("capsule", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        bucket, _, salt = key
        stored = self.capsule.get()
        if stored is None:
            self.handle.registerTimer((int(bucket) + BUCKET_SECONDS) * 1000)
        held = {(template, service): tuple(values) for template, service, *values in (stored[0] if stored else [])}
        changed = set()
        while part := [[r[c] for c in _ROW] for r in islice(rows, ROWS_AT_ONCE)]:
            arrived = defaultdict(list)
            for template, service, *values in part:
                arrived[template, service].append(values)
            for name, values in arrived.items():
                held[name] = self.added(held.get(name), *zip(*values))
            changed.update(arrived)
        self.capsule.update(([(*name, *values) for name, values in held.items()],))
        for name in changed:
            yield Row(*_UPDATE_NAMES)(bucket, salt, *name, *held[name])

    @staticmethod
    def added(held: tuple | None, micros, levels, hashes, ids) -> tuple:
        """The state of one capsule with more rows."""
        first, last, n, severities, known, named = held or (micros[0], micros[0], 0, [0] * len(SEVERITIES), [], [])
        sample = heapq.nsmallest(MAX_SAMPLES, [*zip(known, named), *zip(hashes, ids)])
        return (min(first, *micros), max(last, *micros), n + len(micros), [a + levels.count(s) for a, s in zip(severities, SEVERITIES)],
                [h for h, _ in sample], [i for _, i in sample])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.capsule.clear()
        return iter(())

    def close(self) -> None:
        pass


def capsule_updates(events: DataFrame, mode: str = "compat", lateness: str = LATENESS, salts: int = SALTS) -> DataFrame:
    """New values of the parts of capsules that a batch changes, from state keyed by hour, share and salt.

    The hour carries the watermark, not the time itself: a late row counts as long as the
    watermark has not passed the end of its hour.
    """
    valid, _ = split_valid(events)
    rows = template_messages(valid.withWatermark("timestamp", lateness), mode=mode).withColumn("hour", F.window("timestamp", BUCKET)).select(
        "template", "service_name", F.window_time("hour").alias("closes"), F.unix_seconds("hour.start").alias("bucket"),
        F.pmod(F.xxhash64("template", "service_name"), F.lit(SHARES)).alias("share"), F.pmod(F.xxhash64("event_id"), F.lit(salts)).alias("salt"),
        "severity", F.unix_micros("timestamp").alias("micros"), F.md5("event_id").alias("hash"), "event_id",
    )
    keyed = rows.groupBy("bucket", "share", "salt")
    updates = keyed.transformWithState(CapsuleState(), _UPDATE, "Update", "EventTime")
    return updates.select(
        "template", "service_name", F.timestamp_seconds("bucket").alias("time_bucket"), "salt", F.col("n").alias("count"),
        F.timestamp_micros("first").alias("first_seen_at"), F.timestamp_micros("last").alias("last_seen_at"),
        *[F.col("severities")[i].alias(f"_{s}") for i, s in enumerate(SEVERITIES)], F.arrays_zip("hashes", "ids").alias("sample"),
    )


def start_capsules(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, mode: str = "compat", salts: int = SALTS,
) -> StreamingQuery:
    """Keeps the capsule table at ``path`` as of the last batch; a replayed batch changes nothing."""
    write = upsert_writer(path, [*KEYS, "salt"], "time_bucket", writer="capsules")
    with state_settings(events.sparkSession):
        return (
            capsule_updates(events, mode, salts=salts).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(**(trigger or {"processingTime": "5 minutes"})).start()
        )


def read_capsules(spark: SparkSession, path: str) -> DataFrame:
    """Capsules as of now: their parts added up, and the ten smallest of at most ten samples of each."""
    parts = read_table(spark, path).groupBy(*KEYS).agg(
        F.sum("count").alias("count"), F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"), *[F.sum(f"_{s}").alias(f"_{s}") for s in SEVERITIES],
        F.slice(F.array_sort(F.flatten(F.collect_list("sample"))), 1, MAX_SAMPLES).alias("sample"),
    )
    totals = describe_totals(parts.drop("sample"))
    ids = parts.select(*KEYS, F.col("sample.ids").alias("sample_event_ids"))
    return totals.join(ids, KEYS)


def start_dead_letters(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The branch of rows that fail the validity rules."""
    _, dead = split_valid(events)
    return (
        dead.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch_writer(path))
        .trigger(**(trigger or {"processingTime": "5 minutes"})).start()
    )


def start_undecodable(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, schema: T.StructType = TELEMETRY) -> StreamingQuery:
    """The branch of values that cannot be decoded."""
    return (
        decoded(stream, schema)[1].writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch_writer(path))
        .trigger(**(trigger or {"processingTime": "5 minutes"})).start()
    )


def start_embeddings(
    capsules: DataFrame, embedder: Embedder, vectors: str, fallback: str, refused: str, checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Capsules to vectors, embedded in batches inside every task.

    ``vectors`` is a versioned table by environment, with the columns of ``EMBEDDING``; a
    batch is inserted once. Capsules without an id get the one of their key, capsules
    without an environment count as ``prod``. Unredacted ones go to ``refused``, batches
    the store rejects to ``fallback``. Whatever is left of a batch at the end of a
    trigger is embedded then.
    """
    def store(df: DataFrame, batch_id: int) -> None:
        VersionedTable(df.sparkSession, vectors, "environment").append(df, "embeddings", batch_id)

    write = with_fallback(store, batch_writer(fallback))
    refuse = batch_writer(refused)
    known = capsules.columns
    own = capsule_id() if set(KEY) <= set(known) else F.sha2("template", 256)

    def each(df: DataFrame, batch_id: int) -> None:
        df = df.withColumns({
            "capsule_id": F.coalesce("capsule_id", own) if "capsule_id" in known else own,
            "fingerprint_hash": F.col("fingerprint_hash") if "fingerprint_hash" in known else F.sha2("template", 256),
            "environment": F.coalesce("environment", F.lit("prod")) if "environment" in known else F.lit("prod"),
        })
        admitted, rejected = ready_for_embedding(df, "redaction_applied")
        embedded = embed_with(admitted, "template", embedder).withColumns({
            "embedding_vector": F.col("vector"), "embedding_model": F.lit(embedder.name), "created_at": F.current_timestamp()})
        write(embedded.select(*EMBEDDING.names, "environment"), batch_id)
        refuse(rejected, batch_id)

    return (
        capsules.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
        .trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )


def read_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``batch_writer`` has written so far."""
    df = read_or_none(spark, path)
    return None if df is None else df.drop("batch_id")
