"""The scalar functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from spanwise.functions.text import SENSITIVE_PATTERNS, redact_mobile_record, redact_record


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _redaction() -> str:
    body = "t"
    for _, pattern, mask in SENSITIVE_PATTERNS:
        body = f"regexp_replace({body}, {_literal(pattern)}, '{mask}')"
    return body


FUNCTIONS = {
    "round_half_up(x DOUBLE) RETURNS BIGINT": "cast(floor(x + 0.5) as bigint)",
    "saturation_pct(active DOUBLE, ceiling DOUBLE) RETURNS BIGINT": (
        "case when active is not null and ceiling > 0 then cast(floor(active / ceiling * 100 + 0.5) as bigint) end"
    ),
    "buffer_hit_ratio(logical DOUBLE, physical DOUBLE) RETURNS DOUBLE": (
        "case when logical > 0 and physical is not null "
        "then floor((logical - physical) / logical * 1000 + 0.5) / 10 end"
    ),
    "span_status(code STRING, duration_ms DOUBLE) RETURNS STRING": (
        "case when code in ('2', 'STATUS_CODE_ERROR') then 'ERROR' when duration_ms > 2000 then 'DEGRADED' else 'OK' end"
    ),
    "is_valid_trace_id(v STRING) RETURNS BOOLEAN": (
        "coalesce(v rlike '(?i)^[0-9a-f]{32}$' and not v rlike '^0+$', false)"
    ),
    "is_valid_span_id(v STRING) RETURNS BOOLEAN": (
        "coalesce(v rlike '(?i)^[0-9a-f]{16}$' and not v rlike '^0+$', false)"
    ),
    "decode_db_client_info(v STRING) RETURNS STRING": (
        "nullif(nullif(lower(regexp_extract(v, '(?i)vt=([0-9a-f]{32})', 1)), ''), repeat('0', 32))"
    ),
    "sql_fingerprint(q STRING) RETURNS STRING": (
        r"case when q <> '' then left(trim(regexp_replace(regexp_replace(regexp_replace(q, r'\s+', ' '), "
        r"r'(?<![0-9A-Za-z_])[0-9]+(?![0-9A-Za-z_])', 'N'), r'\x27[^\x27]*\x27', r'\x27?\x27')), 120) end"
    ).replace(r"r'\x27?\x27'", "\"'?'\""),
    "redact_text(t STRING) RETURNS STRING": _redaction(),
    "http_class(code INT) RETURNS STRING": (
        "case when code >= 500 then 'HTTP_SERVER_ERROR' when code >= 400 then 'HTTP_CLIENT_ERROR' "
        "when code is not null then 'HTTP_RESPONSE_OBSERVED' else 'UNKNOWN' end"
    ),
    "severity_rank(s STRING) RETURNS INT": (
        "case s when 'critical' then 4 when 'high' then 3 when 'moderate' then 2 when 'medium' then 2 "
        "when 'low' then 1 else 0 end"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions usable from SQL text in this session."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udf.register("redact_record", redact_record)
    spark.udf.register("redact_mobile_record", redact_mobile_record)
    return [s.split("(")[0] for s in FUNCTIONS] + ["redact_record", "redact_mobile_record"]
