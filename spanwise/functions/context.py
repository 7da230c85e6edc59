"""Trace identifiers and the places they travel in: headers, client info, correlation ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wire formats.
DB_PREFIX = "vt="
MQ_MAGIC = "VTLS"
_HEX_MAGIC = MQ_MAGIC.encode().hex()


def is_valid_trace_id(value: Column) -> Column:
    return F.coalesce(value.rlike("(?i)^[0-9a-f]{32}$") & ~value.rlike("^0+$"), F.lit(False))


def is_valid_span_id(value: Column) -> Column:
    return F.coalesce(value.rlike("(?i)^[0-9a-f]{16}$") & ~value.rlike("^0+$"), F.lit(False))


def parse_traceparent(header: Column) -> Column:
    """Struct (version, trace_id, span_id, flags, sampled), or NULL for anything malformed."""
    parts = F.split(F.trim(header), "-")
    at = [F.lower(F.get(parts, F.lit(i))) for i in range(4)]
    good = (
        (F.size(parts) == 4)
        & at[0].rlike("^[0-9a-f]{2}$")
        & (at[0] != "ff")
        & is_valid_trace_id(at[1])
        & is_valid_span_id(at[2])
        & at[3].rlike("^[0-9a-f]{2}$")
    )
    sampled = F.conv(at[3], 16, 10).cast("int").bitwiseAND(1) == 1
    return F.when(
        good,
        F.struct(
            at[0].alias("version"),
            at[1].alias("trace_id"),
            at[2].alias("span_id"),
            at[3].alias("flags"),
            sampled.alias("sampled"),
        ),
    )


def format_traceparent(trace_id: Column, span_id: Column, sampled: Column, version: str = "00") -> Column:
    return F.when(
        is_valid_trace_id(trace_id) & is_valid_span_id(span_id),
        F.concat_ws("-", F.lit(version), F.lower(trace_id), F.lower(span_id), F.when(sampled, "01").otherwise("00")),
    )


def encode_db_client_info(trace_id: Column, label: Column | None = None) -> Column:
    """The trace id last, so that a truncating server loses the label first."""
    encoded = F.concat(F.lit(DB_PREFIX), F.lower(trace_id))
    if label is not None:
        short = F.left(F.regexp_replace(label, r"\s+", "-"), F.lit(24))
        encoded = F.when(F.coalesce(label, F.lit("")) == "", encoded).otherwise(F.concat_ws(" ", short, encoded))
    return F.when(is_valid_trace_id(trace_id), encoded)


def decode_db_client_info(info: Column) -> Column:
    found = F.lower(F.regexp_extract(info, f"(?i){DB_PREFIX}([0-9a-f]{{32}})", 1))
    return F.when(is_valid_trace_id(found), found)


def encode_mq_correl_id(trace_id: Column, span_id: Column) -> Column:
    """24 bytes: magic, trace id, first four bytes of the span id (zeros where invalid)."""
    prefix = F.when(is_valid_span_id(span_id), F.substring(span_id, 1, 8)).otherwise("0" * 8)
    return F.when(is_valid_trace_id(trace_id), F.unhex(F.concat(F.lit(_HEX_MAGIC), trace_id, prefix)))


def decode_mq_correl_id(correl_id: Column) -> Column:
    """Struct (trace_id, span_id_prefix) from the hex form; foreign ids give NULL."""
    text = F.lower(F.regexp_replace(F.trim(correl_id), "^0[xX]", ""))
    trace = F.substring(text, 9, 32)
    prefix = F.substring(text, 41, 8)
    good = text.rlike(f"^{_HEX_MAGIC}[0-9a-f]{{40}}$") & is_valid_trace_id(trace)
    return F.when(
        good,
        F.struct(trace.alias("trace_id"), F.when(prefix != "0" * 8, prefix).alias("span_id_prefix")),
    )
