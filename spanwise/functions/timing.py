"""Span timing and status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAX_NS = "18446744073709551615"
_MAX_SAFE = 2**53 - 1


def nano(value: Column, integral: bool = False) -> Column:
    """Nanosecond epoch in 1 .. 2^64-1, else NULL. ``integral``: a bigint, which needs no reading as text."""
    if integral:
        return F.when(value > 0, value)
    text = value.cast("string")
    number = F.when(text.rlike("^[0-9]{1,20}$"), text.try_cast("decimal(20,0)"))
    return F.when((number > 0) & (number <= F.lit(_MAX_NS).cast("decimal(20,0)")), number)


def timing_valid(start: Column, end: Column) -> Column:
    s, e = nano(start), nano(end)
    return F.coalesce(e >= s, F.lit(False))


def timing_ms(start: Column, end: Column, integral: bool = False) -> Column:
    """Interval in ms with sub-ms precision; NULL without two valid, ordered timestamps."""
    delta = nano(end, integral) - nano(start, integral)
    return F.when((delta >= 0) & (delta <= F.lit(_MAX_SAFE)), delta.cast("double") / 1e6)


def otel_status_code(code: Column) -> Column:
    """0, 1 or 2 from the number or its enum name."""
    text = code.cast("string")
    return (
        F.when(text.isin("0", "STATUS_CODE_UNSET"), 0)
        .when(text.isin("1", "STATUS_CODE_OK"), 1)
        .when(text.isin("2", "STATUS_CODE_ERROR"), 2)
    )


def span_status(code: Column, duration_ms: Column, legacy: bool = False) -> Column:
    """ERROR for code 2, DEGRADED beyond two seconds, else OK.

    ``legacy`` reads the numeric form only, so that an enum name never becomes ERROR.
    """
    error = (code.cast("string") == "2") if legacy else (otel_status_code(code) == 2)
    return F.when(error, "ERROR").when(duration_ms > 2000, "DEGRADED").otherwise("OK")


def span_kind(kind: Column) -> Column:
    text = kind.cast("string")
    return (
        F.when(text == "SPAN_KIND_SERVER", 2).when(text == "SPAN_KIND_CLIENT", 3).otherwise(text.try_cast("int"))
    )
