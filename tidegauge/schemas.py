"""Row shapes of the data model."""

from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())

TELEMETRY = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("attributes", STRING_MAP),
        T.StructField("raw_blob_s3_key", T.StringType()),
    ]
)

CAPSULE = T.StructType(
    [
        T.StructField("fingerprint_hash", T.StringType()),
        T.StructField("template", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("severity_distribution", T.MapType(T.StringType(), T.LongType())),
        T.StructField("sample_event_ids", T.ArrayType(T.StringType())),
        T.StructField("time_bucket", T.TimestampType()),
        T.StructField("first_seen_at", T.TimestampType()),
        T.StructField("last_seen_at", T.TimestampType()),
    ]
)

EMBEDDING = T.StructType(
    [
        T.StructField("capsule_id", T.StringType()),
        T.StructField("fingerprint_hash", T.StringType()),
        T.StructField("embedding_vector", T.ArrayType(T.FloatType())),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("redaction_applied", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

SPAN = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("span_name", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("attributes", STRING_MAP),
    ]
)

STEP = T.StructType(
    [
        T.StructField("span_name", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("duration_p50", T.DoubleType()),
        T.StructField("error_rate", T.DoubleType()),
    ]
)

METRIC_SAMPLE = T.StructType(
    [
        T.StructField("metric_name", T.StringType()),
        T.StructField("labels", STRING_MAP),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)

_ATTRIBUTE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StructType([T.StructField("stringValue", T.StringType())])),
    ]
)
TRACE_EXPORT = T.StructType(
    [
        T.StructField(
            "resourceSpans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "resource",
                            T.StructType([T.StructField("attributes", T.ArrayType(_ATTRIBUTE))]),
                        ),
                        T.StructField(
                            "scopeSpans",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField(
                                            "spans",
                                            T.ArrayType(
                                                T.StructType(
                                                    [
                                                        T.StructField("traceId", T.BinaryType()),
                                                        T.StructField("spanId", T.BinaryType()),
                                                        T.StructField("name", T.StringType()),
                                                        T.StructField("kind", T.StringType()),
                                                        T.StructField("startTimeUnixNano", T.LongType()),
                                                    ]
                                                )
                                            ),
                                        )
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)
