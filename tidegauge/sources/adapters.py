"""Views that map the supplied business tables onto the telemetry data model.

All of them are deterministic projections (one of them ranks the lines of an order),
so column pruning and filters still reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.constants import ARTIFACT_TYPES
from tidegauge.sources.tables import table


def _text(column: Column) -> Column:
    return column.cast("string")


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """Events as telemetry rows with a message that carries personal data."""
    ev = table(spark, folder, "events")
    user, event, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    whole = F.floor("value").cast("bigint")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    message = (
        F.when(kind == "view", F.concat(
            F.lit("user_id="), _text(user), F.lit(" viewed item "), _text(event),
            F.lit(" from 10."), _text(user % 250), F.lit("."), _text(event % 250), F.lit("."), _text(whole % 250)))
        .when(kind == "click", F.concat(
            F.lit("uid: "), _text(user), F.lit(" clicked banner "), _text(event % 5), F.lit(" at "), stamp))
        .when(kind == "purchase", F.concat(
            F.lit("payment of "), _text(whole), F.lit(" USD by user"), _text(user),
            F.lit("@shop.example card 4111 1111 1111 "), F.lpad(_text(event % 10000), 4, "0")))
        .when(kind == "signup", F.concat(
            F.lit("new account for user"), _text(user), F.lit("@mail.example.org phone 1415555"),
            F.lpad(_text(event % 10000), 4, "0")))
        .otherwise(F.concat(
            F.lit("request "), F.lpad(F.lower(F.hex(event)), 8, "0"),
            F.lit("-0000-4000-8000-000000000000 failed for user_id="), _text(user),
            F.lit(": Bearer tok."), _text(event), F.lit(" rejected after "), _text(whole), F.lit(" ms")))
    )
    trace = F.concat(_text(user), F.lit("-"), F.date_format("ts", "yyyyMMddHH"))
    logged = kind.isin("error", "purchase")
    attributes = F.map_filter(
        F.create_map(
            F.lit("message"), message,
            F.lit("timestamp"), F.when(logged | (kind == "signup"), stamp),
            F.lit("level"), F.when(logged, F.when(kind == "error", "ERROR").otherwise("INFO")),
            F.lit("user_id"), F.when(kind == "purchase", _text(user)),
            F.lit("request_id"), F.when(kind == "purchase", _text(event)),
            F.lit("session_id"), F.when(kind == "signup", trace),
            F.lit("trace_id"), F.when(kind == "error", trace)
            .when(kind == "click", F.when(F.col("value") < 10, "").otherwise(trace)),
            F.lit("span_id"), F.when(kind == "error", _text(event)),
        ),
        lambda k, v: v.isNotNull(),
    )
    return ev.select(
        _text(event).alias("event_id"),
        F.concat(F.lit("svc-"), _text(user % 8)).alias("service_name"),
        F.when(user % 3 == 0, "prod").when(user % 3 == 1, "staging").otherwise("dev").alias("environment"),
        F.when(kind == "view", "trace").when(kind == "click", "metric").otherwise("log").alias("event_type"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO").alias("severity"),
        message.alias("message"),
        trace.alias("trace_id"),
        F.lower(F.hex(event)).alias("span_id"),
        attributes.alias("attributes"),
        F.lit(None).cast("string").alias("raw_blob_s3_key"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a request log."""
    ev = table(spark, folder, "events")
    kind, user = F.col("event_type"), F.col("user_id")
    return ev.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("svc-"), _text(user % 8)).alias("service"),
        F.when(user % 3 == 0, "prod").when(user % 3 == 1, "staging").otherwise("dev").alias("environment"),
        F.concat(F.lit("/"), kind).alias("endpoint"),
        F.when((kind == "error") & (F.col("value") > 50), 503).when(kind == "error", 500)
        .when(kind == "signup", 201).when((kind == "click") & (F.col("value") < 5), 404)
        .otherwise(200).alias("status_code"),
        F.col("value").alias("latency"),
    )


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as root spans, their lines as child spans of a binary tree."""
    root = table(spark, folder, "orders").select(
        _text(F.col("o_orderkey")).alias("trace_id"),
        F.lit("000").alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.concat(F.lit("GET_/"), F.col("o_orderstatus")).alias("span_name"),
        F.concat(F.lit("edge-"), _text(F.col("o_custkey") % 3)).alias("service_name"),
        F.col("o_totalprice").alias("duration_ms"),
        F.lit(False).alias("_error"),
    )
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        "l_discount", "l_tax", "l_shipdate",
    )
    n = F.col("_n")
    lines = (
        table(spark, folder, "lineitem")
        .withColumn("_n", F.row_number().over(order))
        .select(
            _text(F.col("l_orderkey")).alias("trace_id"),
            F.lpad(_text(n), 3, "0").alias("span_id"),
            F.lpad(_text(F.floor(n / 2)), 3, "0").alias("parent_span_id"),
            F.concat_ws("_", "l_returnflag", "l_linestatus").alias("span_name"),
            F.concat(F.lit("svc-"), _text(F.col("l_suppkey") % 7)).alias("service_name"),
            F.col("l_quantity").alias("duration_ms"),
            ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)).alias("_error"),
        )
    )
    return root.unionByName(lines).select(
        "trace_id", "span_id", "parent_span_id", "span_name", "service_name", "duration_ms",
        F.when(F.col("_error"), F.create_map(F.lit("error"), F.lit("true")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("attributes"),
    )


def event_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Events as spans: a user's hour is a trace, each event calls the next one of it."""
    ev = table(spark, folder, "events")
    at = F.col("ts").cast("timestamp")
    rows = ev.select(
        F.concat(_text(F.col("user_id")), F.lit("-"), F.date_format("ts", "yyyyMMddHH")).alias("trace_id"),
        F.lpad(_text(F.col("event_id")), 12, "0").alias("span_id"), F.col("event_type").alias("span_name"),
        F.concat(F.lit("svc-"), _text(F.col("user_id") % 8)).alias("service_name"), F.col("value").alias("duration_ms"), at.alias("timestamp"),
        F.when(F.col("event_type") == "error", F.create_map(F.lit("error"), F.lit("true"))).otherwise(
            F.create_map().cast("map<string,string>")).alias("attributes"),
    )
    order = Window.partitionBy("trace_id").orderBy("timestamp", "span_id")
    return rows.withColumn("parent_span_id", F.lag("span_id").over(order))


def event_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Traces of events as requests to their entry point: its duration as seconds, 503 where any span failed."""
    spans = event_spans(spark, folder)
    bad = F.coalesce(F.col("attributes")["error"] == "true", F.lit(False))
    first = F.min(F.struct(F.col("parent_span_id").isNotNull().alias("nested"), "timestamp", "service_name", "span_name", "duration_ms")).alias("f")
    traces = spans.groupBy("trace_id").agg(first, F.bool_or(bad).alias("failed"))
    return traces.select(
        F.col("f.service_name").alias("job"), F.concat_ws(":", "f.service_name", "f.span_name").alias("endpoint"),
        F.col("f.timestamp").alias("ts"), F.col("f.duration_ms").alias("seconds"), F.when(F.col("failed"), "503").otherwise("200").alias("status"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings with the metadata of a vector collection; one hour bucket per id."""
    v = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        _text(v).alias("capsule_id"),
        F.sha2(_text(v), 256).alias("fingerprint_hash"),
        F.concat(F.lit("svc-"), _text(F.col("label"))).alias("service_name"),
        F.when(v % 3 == 0, "prod").when(v % 3 == 1, "staging").otherwise("dev").alias("environment"),
        F.when(v % 5 == 0, "ERROR").otherwise("INFO").alias("severity"),
        F.timestamp_seconds(F.lit(1704067200) + v * 3600).alias("time_bucket"),
        F.col("embedding").alias("vector"),
    )


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """One unit query vector per service: the mean direction of its vectors.

    The element-wise mean is a grouped aggregate over (service, position), so a service
    that owns a third of all vectors is still reduced on the map side.
    """
    cells = table(spark, folder, "embeddings").select(
        F.concat(F.lit("svc-"), _text(F.col("label"))).alias("service_name"),
        F.posexplode("embedding").alias("pos", "x"),
    )
    means = cells.groupBy("service_name", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # one row per service; the list is as long as a vector, never as long as the data
    packed = means.groupBy("service_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("m")
    )
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    return packed.select(
        F.col("service_name").alias("query_id"),
        "service_name",
        F.transform("m", lambda x: x / norm).alias("vector"),
    )


def services(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as services; region is the organisation."""
    nation = table(spark, folder, "nation")
    return (
        table(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("service_id"),
            F.concat(F.lit("svc-"), _text(F.col("s_suppkey"))).alias("name"),
            F.when(F.col("s_suppkey") % 3 == 0, "prod").when(F.col("s_suppkey") % 3 == 1, "staging")
            .otherwise("dev").alias("environment"),
            F.concat(F.lit("org-"), _text(F.col("n_regionkey"))).alias("organization_id"),
            F.when(F.col("s_acctbal") < 0, "paused").otherwise("active").alias("status"),
        )
    )


def journeys(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as journeys: traffic and endpoints come from their order lines."""
    lines = table(spark, folder, "lineitem")
    return (
        lines.groupBy("l_partkey")
        .agg(
            F.min("l_suppkey").alias("service_id"),
            F.count(F.lit(1)).alias("traffic_volume_per_day"),
            # at most one entry per flag and status pair
            F.array_sort(F.collect_set(F.concat_ws("_", "l_returnflag", "l_linestatus"))).alias("endpoints"),
            F.min("l_shipdate").cast("timestamp").alias("discovered_at"),
            F.max("l_shipdate").cast("timestamp").alias("last_seen_at"),
        )
        .select(
            F.col("l_partkey").alias("journey_id"),
            "service_id",
            F.concat(F.lit("part-"), _text(F.col("l_partkey"))).alias("name"),
            F.concat(F.lit("/api/part/"), _text(F.col("l_partkey"))).alias("entry_point"),
            F.concat(F.lit("svc:"), F.element_at("endpoints", 1)).alias("exit_point"),
            "traffic_volume_per_day", "endpoints", "discovered_at", "last_seen_at",
        )
    )


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines' parts crossed with the four artifact kinds, one artifact each.

    ``slo_id`` and ``sli_id`` equal the part key; parts of the largest size have no
    objective, so that broken links exist.
    """
    parts = table(spark, folder, "part")
    kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(ARTIFACT_TYPES)])
    return parts.select("p_partkey", F.explode(kinds).alias("k")).select(
        (F.col("p_partkey") * 4 + F.col("k.i")).alias("artifact_id"),
        F.col("p_partkey").alias("slo_id"),
        F.col("k.kind").alias("artifact_type"),
        F.when((F.col("p_partkey") + F.col("k.i")) % 5 == 0, "pending").otherwise("approved").alias("approval_status"),
        F.lit("deploy").alias("action"),
    )


def objectives(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    return parts.filter(F.col("p_size") < 50).select(
        F.col("p_partkey").alias("slo_id"),
        F.col("p_partkey").alias("sli_id"),
        F.col("p_size").cast("double").alias("threshold_value"),
        F.lit("gt").alias("comparison_operator"),
        F.lit(99.0).alias("target_percentage"),
    )


def indicators(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("sli_id"),
        F.col("p_partkey").alias("journey_id"),
        F.concat(F.col("p_name"), F.lit("-latency-p95")).alias("name"),
        F.when(F.col("p_size") % 2 == 0, "latency").otherwise("error_rate").alias("metric_type"),
    )
