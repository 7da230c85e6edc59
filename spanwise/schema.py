"""Record shapes shared by the operators. Every field is nullable and none is defaulted."""

from __future__ import annotations

from pyspark.sql import types as T

# The vocabularies results are written in.
STATUSES = ("OK", "DEGRADED", "ERROR")
EVIDENCE_STATUSES = ("SUCCESS", "WARNING", "DEGRADED", "FAILED", "UNKNOWN")
STAGES = ("OBSERVED", "CORRELATED", "INFERRED", "RECOMMENDED", "APPROVED", "EXECUTED", "VERIFIED")
SOURCE_TYPES = ("REAL", "SYNTHETIC", "REPLAY", "INFERRED", "LEARNED")
EDGE_TYPES = (
    "OBSERVED_AT", "ROUTED_TO", "FORWARDED_TO", "CALLS", "WAITS_FOR", "BLOCKED_BY", "DEPENDS_ON",
    "RETRIED_BY", "TIMED_OUT_AT", "CAUSED", "CORRELATED_WITH", "CHANGED_BY", "RECOVERED_AFTER", "VERIFIED_BY",
)
DNA_VERSION = "2.1.0"

ATTRIBUTE_VALUE = T.StructType(
    [
        T.StructField("stringValue", T.StringType()),
        T.StructField("intValue", T.StringType()),
        T.StructField("doubleValue", T.DoubleType()),
        T.StructField("boolValue", T.BooleanType()),
        T.StructField("arrayValue", T.StringType()),
        T.StructField("kvlistValue", T.StringType()),
        T.StructField("bytesValue", T.StringType()),
    ]
)
ATTRIBUTES = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", ATTRIBUTE_VALUE)])
)

SPANS = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("service", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("start_ns", T.DecimalType(20, 0)),
        T.StructField("end_ns", T.DecimalType(20, 0)),
        T.StructField("timing_valid", T.BooleanType()),
        T.StructField("timing_ms", T.DoubleType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("observed_ms", T.LongType()),
        T.StructField("received_ms", T.LongType()),
        T.StructField("otel_status_code", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("service_version", T.StringType()),
        T.StructField("artifact_digest", T.StringType()),
        T.StructField("deployment_environment", T.StringType()),
        T.StructField("attributes", ATTRIBUTES),
        T.StructField("ingest_seq", T.LongType()),
    ]
)

_OTLP_ATTRIBUTE = (
    "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,"
    "arrayValue:string,kvlistValue:string,bytesValue:string>>>"
)
OTLP_TRACES = (
    f"struct<resourceSpans:array<struct<resource:struct<attributes:{_OTLP_ATTRIBUTE}>,"
    "scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,"
    "kind:string,startTimeUnixNano:string,endTimeUnixNano:string,durationMs:double,"
    f"status:struct<code:string>,attributes:{_OTLP_ATTRIBUTE}>>>>>>,torn:string>"
)
