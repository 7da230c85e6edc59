"""Evidence envelopes and the wide request record assembled from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.numbers import round_exact
from spanwise.schema import DNA_VERSION

# Sections of the wide record and the tier each is read from.
DNA_SECTIONS = {
    "client": "CLIENT", "network": "NETWORK", "dns": "DNS", "tls": "TLS", "security": "FIREWALL", "load_balancer": "LOAD_BALANCER",
    "web_server": "WEB_SERVER", "app_server": "WEBSPHERE", "messaging": "MESSAGE_BROKER", "database": "DB2",
    "external_gateway": "EXTERNAL_GATEWAY", "return_journey": "CLIENT_RETURN",
}
_TEXT = (
    "evidence_id", "trace_id", "request_id", "span_id", "parent_span_id", "component_type", "component_name", "environment",
    "region", "cluster", "event_type", "phase", "status", "sql_fingerprint", "correlation_id", "message_id", "thread_id", "vip",
    "client_ip", "source_type", "source_system", "collection_method", "classification", "claim", "tenant_id",
)
_NUMBERS = (
    "event_ms", "duration_ms", "expected_ms", "observed_ms", "lock_wait_ms", "pool_utilization", "cpu_pct", "socket_rtt_ms",
    "tcp_retransmits", "db_pid", "confidence",
)
_FLAGS = ("observed", "contains_pii", "redaction_applied")


def envelopes(raw: DataFrame) -> DataFrame:
    """Nested envelopes from flat rows; documented defaults for labels, none for measurements.

    A row without trace id is kept under an UNASSOCIATED id made from its content.
    """
    for names, kind in ((_TEXT, "string"), (_NUMBERS, "double"), (_FLAGS, "boolean")):
        for name in names:
            if name not in raw.columns:
                raw = raw.withColumn(name, F.lit(None).cast(kind))

    def text(name: str, default: str | Column) -> Column:
        other = default if isinstance(default, Column) else F.lit(default)
        return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), other)

    def number(name: str, default: float | None = None) -> Column:
        value = F.col(name).cast("double")
        return value if default is None else F.coalesce(value, F.lit(float(default)))

    content = F.sha2(F.to_json(F.struct(*[F.col(n) for n in _TEXT + _NUMBERS])), 256)
    rows = raw.withColumn("_content", content)
    trace = text("trace_id", F.concat(F.lit("UNASSOCIATED-"), F.left("_content", F.lit(16))))
    evidence = text("evidence_id", F.concat(F.lit("ev-"), F.left("_content", F.lit(16))))
    return rows.select(
        evidence.alias("evidence_id"),
        trace.alias("trace_id"),
        text("request_id", F.concat(F.lit("req-"), trace)).alias("request_id"),
        text("span_id", F.concat(F.lit("span-"), evidence)).alias("span_id"),
        F.col("parent_span_id"),
        F.struct(
            F.col("component_type").alias("type"), F.col("component_name").alias("name"),
            text("environment", "production").alias("environment"), F.col("region"), F.col("cluster"),
        ).alias("component"),
        F.struct(
            text("event_type", "EXECUTION").alias("type"), text("phase", "FORWARD").alias("phase"),
            F.col("event_ms").cast("bigint").alias("event_ms"), number("duration_ms").alias("duration_ms"),
            text("status", "UNKNOWN").alias("status"),
        ).alias("event"),
        F.struct(
            number("expected_ms", 20).alias("expected_ms"),
            F.coalesce(number("observed_ms"), number("duration_ms")).alias("observed_ms"),
            *[number(n).alias(n) for n in ("lock_wait_ms", "pool_utilization", "cpu_pct", "socket_rtt_ms", "tcp_retransmits")],
        ).alias("measurements"),
        F.struct(
            "sql_fingerprint", F.col("db_pid").cast("bigint").alias("db_pid"), "correlation_id", "message_id", "thread_id", "vip",
            "client_ip",
        ).alias("identity"),
        F.struct(
            text("source_type", "NATIVE_ADAPTER").alias("source_type"), text("source_system", F.col("component_type")).alias("source_system"),
            text("collection_method", "OUT_OF_BAND").alias("collection_method"), F.col("observed"), number("confidence").alias("confidence"),
        ).alias("provenance"),
        F.struct(
            text("classification", "OBSERVED").alias("classification"),
            text("claim", F.concat_ws(" executed ", "component_name", text("event_type", "EXECUTION"))).alias("claim"),
        ).alias("epistemic"),
        F.struct(
            F.coalesce("contains_pii", F.lit(False)).alias("contains_pii"),
            F.coalesce("redaction_applied", F.lit(False)).alias("redaction_applied"),
            text("tenant_id", "default-tenant").alias("tenant_id"),
        ).alias("security"),
    )


def validate_envelopes(nested: DataFrame) -> DataFrame:
    """Add ``errors`` (what is missing) and ``is_valid``."""

    def missing(path: str, label: str) -> Column:
        return F.when(F.coalesce(F.col(path).cast("string"), F.lit("")) == "", f"Missing {label}")

    errors = F.array_compact(
        F.array(
            missing("evidence_id", "evidence id"),
            missing("trace_id", "trace id"),
            missing("component.type", "component type"),
            missing("component.name", "component name"),
            missing("event.event_ms", "event time"),
            missing("epistemic.classification", "classification"),
        )
    )
    return nested.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def request_dna_wide(flat: DataFrame, floor: float = 1.5) -> DataFrame:
    """One wide versioned record per trace: a section per tier, totals, and the first deviation.

    ``flat`` has trace_id, ingest_seq, component_type, component_name, status, observed_ms,
    expected_ms and anything to be carried in a section. The first envelope of a tier speaks for it.
    """
    c = F.col
    keys = ("trace_id", "ingest_seq", "component_type")
    section = F.struct(*[c(x) for x in flat.columns if x not in keys])
    multiple = c("observed_ms") / F.greatest(F.lit(0.1), F.coalesce("expected_ms", F.lit(20)))
    rank = F.struct(multiple.alias("m"), (-c("ingest_seq")).alias("s"))
    deviation = F.struct(
        c("component_type").alias("node"), "observed_ms", F.coalesce("expected_ms", F.lit(20)).alias("expected_ms"),
        round_exact(multiple, 1).alias("multiple"),
    )
    tiers = flat.groupBy("trace_id", "component_type").agg(
        F.min_by(section, "ingest_seq").alias("section"),
        F.sum("observed_ms").alias("ms"),
        F.min("ingest_seq").alias("at"),
        F.max_by(deviation, F.when(multiple > floor, rank)).alias("deviation"),
        F.max(F.when(multiple > floor, rank)).alias("rank"),
    )
    wide = tiers.groupBy("trace_id").agg(
        *[F.first(F.when(c("component_type") == tier, c("section")), ignorenulls=True).alias(name) for name, tier in DNA_SECTIONS.items()],
        F.sum("ms").alias("total_ms"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("at", c("component_type").alias("node"), c("ms").alias("duration_ms")))),
            lambda h: F.struct(h["node"].alias("node"), h["duration_ms"].alias("duration_ms")),
        ).alias("hop_deltas"),
        F.max_by("deviation", "rank").alias("first_deviation"),
    )
    return wide.select(
        F.lit(DNA_VERSION).alias("schema_version"), "trace_id", *DNA_SECTIONS,
        F.struct("total_ms", "hop_deltas", "first_deviation").alias("temporal_lineage"),
    )


def validate_dna(wide: DataFrame) -> DataFrame:
    problem = F.when(
        ~F.col("schema_version").eqNullSafe(F.lit(DNA_VERSION)), "unsupported schema version"
    ).when(F.coalesce(F.col("trace_id").cast("string"), F.lit("")) == "", "missing trace id")
    return wide.withColumn("error", problem).withColumn("is_valid", F.col("error").isNull())
